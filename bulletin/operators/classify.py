"""Category of an announcement by tiers of words, arbitration, re-labelling."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import _c

# Words of each category in title and in the URL's last word, in order of trial.
TENDER_WORDS = [
    "बोलपत्र", "सिलबन्दी दरभाउपत्र", "दरभाउपत्र", "ठेक्का", "लिलाम", "खरिद सम्बन्धी", "इ-बिडिङ", "आशयको सूचना", "बोलपत्र स्वीकृत", "प्रस्ताव आह्वान",
    "बोलपत्र फाराम", "कोटेशन", "बोलपत्र रद्द", "दरभाउ पत्र", "सिलबन्दी", "बोलपत्र मूल्याङ्कन", "tender", "sealed quotation", "quotation", "e-bidding",
    "procurement", "bidding", "expression of interest", "eoi", "request for proposal", "rfp", "invitation for bid", "ifb",
    "re-tender", "auction", "bid submission", "bid opening", "bolpatra",
]
VACANCY_WORDS = [
    "पदपूर्ति", "कर्मचारी आवश्यकता", "दरखास्त", "नियुक्ति", "विज्ञापन नं", "विज्ञापन सम्बन्धी", "लिखित परीक्षा", "अन्तर्वार्ता", "नतिजा प्रकाशन", "सिफारिस सम्बन्धी",
    "रिक्त पद", "सेवा करार", "खुला प्रतियोगिता", "योग्यताक्रम", "पदस्थापन", "परीक्षा तालिका", "प्रवेशपत्र", "करार सेवा", "रोजगार", "उम्मेदवार", "रोष्टर",
    "vacancy", "vacancies", "recruitment", "career", "careers", "job opening", "hiring", "written exam", "interview result",
    "appointment", "karmachari",
]
PRESS_WORDS = [
    "प्रेस विज्ञप्ति", "प्रेस नोट", "प्रेस-विज्ञप्ति", "पत्रकार सम्मेलन", "प्रेस वक्तव्य", "प्रेस रिलिज", "विज्ञप्ति", "प्रेस नोटः", "संयुक्त वक्तव्य", "press release",
    "press note", "press statement", "media release", "press-release", "pressrelease", "press conference", "joint communique",
    "official statement",
]
CIRCULAR_WORDS = [
    "परिपत्र", "निर्देशिका", "कार्यविधि", "मापदण्ड", "विनियमावली", "निर्देशन सम्बन्धी", "आदेश", "राजपत्र", "ऐन तथा नियम", "मार्गदर्शन", "प्रक्रियागत",
    "सञ्चालन कार्यविधि", "circular", "directive", "directives", "guideline", "guidelines", "paripatra", "manual", "regulation",
    "standard operating",
]
NEWS_WORDS = [
    "समाचार", "ताजा समाचार", "बुलेटिन", "गतिविधि", "कार्यक्रम सम्बन्धी", "वार्षिक प्रतिवेदन", "समीक्षा गोष्ठी", "उद्घाटन", "समारोह", "news", "bulletin",
    "newsletter", "events", "activities", "monthly bulletin", "quarterly bulletin", "annual report",
]
NOTICE_WORDS = [
    "सूचना", "सुचना", "सार्वजनिक सूचना", "अत्यावश्यक", "जानकारी", "विवरण", "छपाई भएका", "सवारी चालक अनुमतिपत्र", "सवारी", "स्मार्ट कार्ड", "लाइसेन्स", "निर्णय",
    "सूचना पाटी", "तालिम", "छात्रवृत्ति", "नतिजा", "अनुमोदन", "प्रतिवेदन", "प्रकाशन", "notice", "suchana", "announcement", "license",
    "driving license", "information", "public notice", "decision", "result", "scholarship", "training", "schedule",
]
#: Category, confidence, title words, slug words.
TIERS = [
    ("TENDER", 0.95, TENDER_WORDS, ["tender", "bid", "quotation", "procurement", "bolpatra"]),
    ("JOB", 0.95, VACANCY_WORDS, ["vacancy", "recruitment", "career", "job", "padpurti"]),
    ("PRESS_RELEASE", 0.95, PRESS_WORDS, ["press-release", "pressrelease", "press_release", "press-note", "media-release"]),
    ("CIRCULAR", 0.90, CIRCULAR_WORDS, ["circular", "directive", "guideline", "paripatra", "manual"]),
    ("NEWS", 0.90, NEWS_WORDS, ["news", "bulletin", "newsletter", "samachar", "events"]),
    ("NOTICE", 0.85, NOTICE_WORDS, ["notice", "suchana", "announcement", "license", "details-of-printed-licenses"]),
]
#: Of the employment tier, what makes it a vacancy and not a job.
VACANT = ["vacancy", "दरखास्त", "विज्ञापन", "परीक्षा"]
#: Category, confidence and words for the text, after the route's category.
IN_TEXT = [
    ("TENDER", 0.75, TENDER_WORDS[:10]), ("VACANCY", 0.75, VACANCY_WORDS[:10]), ("PRESS_RELEASE", 0.75, PRESS_WORDS[:5]),
    ("CIRCULAR", 0.70, CIRCULAR_WORDS[:5]),
]
#: Categories of routes.
ROUTES = {
    "NOTICE": "NOTICE", "NOTICES": "NOTICE", "BULLETIN": "NOTICE", "SUCHANA": "NOTICE", "NEWS": "NEWS", "SAMACHAAR": "NEWS",
    "SAMACHAR": "NEWS", "PRESS": "PRESS_RELEASE", "PRESS_RELEASE": "PRESS_RELEASE", "PRESSRELEASE": "PRESS_RELEASE",
    "CIRCULAR": "CIRCULAR", "PARIPATRA": "CIRCULAR", "TENDER": "TENDER", "BID": "TENDER", "BOLI": "TENDER", "VACANCY": "VACANCY",
    "JOB": "JOB", "CAREER": "JOB", "RECRUITMENT": "JOB", "INTERN": "INTERNSHIP", "INTERNSHIP": "INTERNSHIP",
    "TRAINEE": "INTERNSHIP", "OTHER": "OTHER",
}


def any_word(c: Column, words: list[str]) -> Column:
    """Whether one of the words is in the text, by one expression."""
    return c.rlike("|".join(re.escape(w) for w in words))


def route_category(c: str | Column) -> Column:
    """Standard category of a route's name: of the whole name or of what stands before its first underscore."""
    name = F.upper(F.trim(_c(c)))
    table = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    found = F.coalesce(F.try_element_at(table, name), F.try_element_at(table, F.substring_index(name, "_", 1)), F.lit("NOTICE"))
    return F.when(name.isNull() | (name == ""), "NOTICE").otherwise(found)


def source_slug(url: str | Column) -> Column:
    """The last word of a URL's path that is no number; null if there is none."""
    path = F.regexp_extract(_c(url), r"//[^/?#]*([^?#]*)", 1)
    words = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^\d+$"))
    return F.when(F.size(words) > 0, F.get(words, F.size(words) - 1))


def classify(title: str | Column, url: str | Column, route: str | Column, text: str | Column) -> Column:
    """(category, confidence, slug) of an announcement.

    The tiers' words in its title or its URL's last word; then its route's category at 0.80; then
    words in the first 1500 characters of text and the title; else NOTICE at 0.50.
    """
    slug = source_slug(url)
    low = F.lower(F.coalesce(_c(title), F.lit("")))
    short = F.lower(F.coalesce(slug, F.lit("")))
    both = F.concat(F.lower(F.substring(F.coalesce(_c(text), F.lit("")), 1, 1500)), F.lit(" "), low)
    answer = lambda name, p: F.struct(name.alias("category"), F.lit(p).alias("confidence"), slug.alias("slug"))
    tests = []
    for name, p, words, in_slug in TIERS:
        told = F.lit(name)
        if name == "JOB":
            told = F.when(any_word(low, VACANT) | any_word(F.coalesce(slug, F.lit("")), VACANT), "VACANCY").otherwise("JOB")
        tests.append(F.when(any_word(low, words) | any_word(short, in_slug), answer(told, p)))
    known = route_category(route)
    tests.append(F.when((F.coalesce(_c(route), F.lit("")) != "") & (known != "OTHER"), answer(known, 0.80)))
    tests += [F.when(any_word(both, words), answer(F.lit(name), p)) for name, p, words in IN_TEXT]
    return F.coalesce(*tests, answer(F.lit("NOTICE"), 0.50))


#: Words that the batch run has besides, what makes a vacancy there, and words for its texts.
BATCH_MORE = {"JOB": ["प्राविधिक अधिकृत", "सहायक स्तर"], "PRESS_RELEASE": ["विज्ञप्ती"]}
BATCH_VACANT = ["vacancy", "दरखास्त", "विज्ञापन", "परीक्षा", "उम्मेदवार", "पदपूर्ति"]
BATCH_KEPT = ["TENDER", "VACANCY", "JOB", "PRESS_RELEASE", "CIRCULAR", "NEWS", "NOTICE"]
BATCH_IN_TEXT = [
    ("TENDER", TENDER_WORDS[:8]), ("VACANCY", VACANCY_WORDS[:8]), ("PRESS_RELEASE", PRESS_WORDS[:5]), ("CIRCULAR", CIRCULAR_WORDS[:5]), ("NEWS", NEWS_WORDS[:4]),
]


def reclassified(title: str | Column, url: str | Column, text: str | Column, current: str | Column) -> Column:
    """The category that the batch run over stored announcements gives.

    The tiers' words in the title or the URL's last word, in lower case; else the category it has,
    if that is one of the known; else words in the first 1200 characters of text and the title.
    """
    low, slug = F.lower(F.coalesce(_c(title), F.lit(""))), F.lower(F.coalesce(source_slug(url), F.lit("")))
    both = F.concat(F.lower(F.substring(F.coalesce(_c(text), F.lit("")), 1, 1200)), F.lit(" "), low)
    tests = []
    for name, _, words, in_slug in TIERS:
        told = F.lit(name)
        if name == "JOB":
            told = F.when(any_word(low, BATCH_VACANT) | any_word(slug, BATCH_VACANT), "VACANCY").otherwise("JOB")
        tests.append(F.when(any_word(low, words + BATCH_MORE.get(name, [])) | any_word(slug, in_slug), told))
    tests.append(F.when(_c(current).isin(BATCH_KEPT), _c(current)))
    tests += [F.when(any_word(both, words), F.lit(name)) for name, words in BATCH_IN_TEXT]
    return F.coalesce(*tests, F.lit("NOTICE"))


def arbitrated(model: Column, model_confidence: Column, slug: Column, slug_confidence: Column) -> Column:
    """The model's category above 0.6, else the slug's from 0.8, else the surer of the two at 0.4 or more."""
    return F.when(model_confidence > 0.6, model).when(slug_confidence >= 0.8, slug).when(model_confidence > slug_confidence, model).otherwise(slug)


def employment(category: Column, title: Column) -> Column:
    """Vacancies split into internships and jobs; the internship words go first."""
    t = F.lower(title)
    return F.when((category == "VACANCY") & t.rlike("intern|trainee"), "INTERNSHIP").when(category == "VACANCY", "JOB").otherwise(category)


def reference(text: str | Column) -> Column:
    """The first reference number of 3 to 50 characters."""
    found = F.regexp_extract(F.substring(_c(text), 1, 3000), r"(?i)\b(?:ref|reference|no|number)\.?\s*(?:no\.?)?\s*[:#]\s*([A-Z0-9][A-Z0-9/\-]{2,49})", 1)
    return F.when(found != "", found)
