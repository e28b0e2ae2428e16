"""Source types, brand candidates, page types and content flags, as ordered rules over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions.text import LINE_END, detect_terms, fold, folded, headings, lines
from citeweave.functions.urls import domain, root_domain

# Endings of institutions' hosts, in order.
OFFICIAL = {
    ".gov": "government", ".mil": "government", ".int": "government", ".go.th": "government", ".go.jp": "government",
    ".go.kr": "government", ".go.id": "government", ".gob": "government", ".edu": "education", ".ac": "education",
}
# Known hosts by type, in order.
KNOWN = {
    "news": ("nytimes.com", "bbc.com", "bbc.co.uk", "cnn.com", "reuters.com", "theguardian.com", "apnews.com", "bloomberg.com", "forbes.com",
        "wsj.com", "washingtonpost.com", "aljazeera.com", "ft.com", "nbcnews.com", "cnbc.com", "businessinsider.com", "techcrunch.com",
        "theverge.com", "wired.com", "bangkokpost.com", "nationthailand.com"),
    "forum": ("reddit.com", "quora.com", "stackoverflow.com", "stackexchange.com", "ycombinator.com", "discourse.org"),
    "reference": ("wikipedia.org", "wiktionary.org", "britannica.com", "fandom.com", "investopedia.com"),
    "video": ("youtube.com", "youtu.be", "vimeo.com"),
    "social": ("twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "tiktok.com", "threads.net", "pinterest.com", "medium.com"),
    "ecommerce": ("amazon.com", "ebay.com", "etsy.com", "aliexpress.com", "alibaba.com", "walmart.com", "bestbuy.com", "lazada.com", "shopee.com",
        "shopify.com"),
    "review": ("yelp.com", "tripadvisor.com", "trustpilot.com", "g2.com", "capterra.com", "glassdoor.com"),
    "blog": ("substack.com", "wordpress.com", "blogspot.com", "blogger.com", "tumblr.com", "dev.to", "ghost.io", "hashnode.dev"),
    "documentation": ("readthedocs.io", "readthedocs.org", "developer.mozilla.org", "github.io"),
}
# What hosts of a type start with or contain.
HINTS = (
    ("documentation", ("docs.", "developer.", "dev."), ()), ("blog", ("blog.",), (".blog",)), ("forum", ("forum.", "community."), ("forum",)),
    ("ecommerce", ("shop.", "store."), ("shop",)), ("news", (), ("news",)), ("reference", (), ("wiki",)),
)
NEVER_BRAND = ("news", "forum", "reference", "video", "social", "review", "documentation")
HOME_HINTS = ("about", "contact", "service", "services", "home", "booking", "shop", "store")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def institutional(url: Column) -> Column:
    host = domain(url)
    hit = F.lit(False)
    for tld in OFFICIAL:
        hit = hit | host.endswith(tld) | host.contains(tld + ".")
    return hit


def source_type(url: Column) -> Column:
    """Institution, known host, hint in the host, or unknown: the first rule that holds."""
    host, root = domain(url), root_domain(url)
    rule = F.when(host == "", F.lit("unknown"))
    for tld, label in OFFICIAL.items():
        rule = rule.when(host.endswith(tld) | host.contains(tld + "."), label)
    for label, names in KNOWN.items():
        rule = rule.when(root.isin(*names), label)
    for label, names in KNOWN.items():
        for name in names:
            if name.count(".") > 1 or name in ("github.io", "readthedocs.io"):  # others are roots of all their hosts
                rule = rule.when((host == name) | host.endswith("." + name), label)
    for label, starts, parts in HINTS:
        hit = _any(host, parts)
        for s in starts:
            hit = hit | host.startswith(s)
        rule = rule.when(hit, label)
    return rule.otherwise("unknown")


def brand_candidate(url: Column, title: Column, query: Column, answer: Column) -> Column:
    """Does the page look like the site of the entity that title, query or answer name?"""
    label = F.split(root_domain(url), r"\.")[0]
    named = lambda text, n: F.exists(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z]{{{n},}}"), F.lit(0)), lambda w: F.contains(label, w))
    low = F.lower(url)
    slashes = F.length(F.regexp_replace(F.regexp_replace(low, "/+$", ""), "[^/]", ""))
    homely = _any(low, HOME_HINTS) | (slashes <= 3)
    asked = F.concat_ws(" ", F.coalesce(query, F.lit("")), F.coalesce(answer, F.lit("")))
    own = ~institutional(url) & ~source_type(url).isin(*NEVER_BRAND) & (F.length(label) >= 5)
    return own & (named(title, 4) | (homely & named(asked, 5)))


# Words that raise a content flag, in both languages.
FLAG_WORDS = {
    "has_faq": ("faq", "q&a", "q & a", "frequently asked", "คำถามที่พบบ่อย", "ถาม-ตอบ", "ถาม ตอบ"),
    "has_step_by_step": ("step by step", "step-by-step", "how to", "procedure", "steps", "ขั้นตอน", "วิธีการ", "วิธี"),
    "has_contact_info": ("contact us", "contact", "ติดต่อ", "ติดต่อเรา"),
    "has_location_info": ("address", "location", "directions", "how to get", "ที่ตั้ง", "แผนที่", "การเดินทาง"),
    "has_price_or_package": ("price", "pricing", "package", "cost", "fee", "promotion", "ราคา", "แพ็กเกจ", "แพคเกจ", "ค่าบริการ", "โปรโมชั่น"),
    "has_opening_hours": ("opening hours", "open hours", "hours of operation", "business hours", "เวลาทำการ", "เปิดบริการ", "เวลาเปิด"),
    "has_booking_or_appointment": ("booking", "book now", "appointment", "reserve", "reservation", "test drive", "นัดหมาย", "จองคิว", "จอง", "ทดลองขับ"),
    "has_author": ("written by", "author", "เขียนโดย", "ผู้เขียน", "แพทย์ผู้เขียน"),
    "has_reviewer": ("reviewed by", "medically reviewed", "fact checked", "ตรวจทานโดย", "ผู้ตรวจทาน"),
    "has_published_date": ("published", "posted on", "date published", "เผยแพร่", "วันที่เผยแพร่"),
    "has_updated_date": ("updated", "last updated", "อัปเดต", "ปรับปรุงล่าสุด", "แก้ไขล่าสุด"),
}
# Patterns of a phone number and, from the last character before the sign, of an e-mail address.
PHONE = r"(?:\+?\d[\d\-\s().]{6,}\d)"
EMAIL = r"[a-z0-9._%+\-]@[a-z0-9.\-]+\.[a-z]{2,}"
GENERIC_INTENT = ("unspecified", "other", "general", "info", "intent", "and", "the", "for")
# Page types by words of the URL, around the rules that look at flags.
PATH_TYPES = (
    ("contact_page", ("/contact", "ติดต่อ"), None), ("appointment_page", ("/appointment", "/booking", "/book", "นัดหมาย"), None),
    ("location_page", ("/location", "/map", "/directions", "แผนที่"), None), ("faq_page", ("/faq", "faq", "คำถาม"), None),
    ("price_package_page", ("/price", "/pricing", "/package", "ราคา", "แพ็กเกจ"), "has_price_or_package"),
    ("service_page", ("/service", "/treatment", "บริการ"), None), ("department_page", ("/department", "/dept", "/center", "/centre", "แผนก", "ศูนย์"), None),
    ("directory_page", ("/directory", "/find-a", "/listing"), None),
)
MARKET_WORDS = ("/search", "/category", "/c/", "listing", "/browse")


def all_words(title: Column, text: Column, markdown: Column, heads: Column | None = None) -> Column:
    """Title, headings and text of a page as one text.  ``heads``: the markdown's headings, where the caller has them."""
    heads = headings(markdown) if heads is None else heads
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.array_join(heads, " "), F.coalesce(text, F.lit("")))


def content_flags(title: Column, text: Column, markdown: Column, html: Column, intent: Column, ascii_only: bool = False, everything: Column | None = None, heads: Column | None = None) -> dict[str, Column]:
    """Boolean columns that say what a page offers; heuristics, not ground truth.  ``everything``:
    ``all_words``, folded, where the caller has it as a column; else it is made anew for every word looked for.
    ``heads``: the markdown's headings, where the caller has them."""
    everything = fold(all_words(title, text, markdown), ascii_only) if everything is None else everything
    flags = {name: _any(everything, tuple(map(folded, words))) for name, words in FLAG_WORDS.items()}
    body, md, raw = (F.coalesce(c, F.lit("")) for c in (text, markdown, html))
    flags["has_phone_number"] = body.rlike(PHONE)
    flags["has_email"] = fold(body, ascii_only).rlike(EMAIL)
    flags["has_schema"] = _any(fold(F.concat_ws(" ", body, raw), ascii_only), ("schema.org", "ld+json"))
    rows = F.size(F.filter(lines(md), lambda x: F.substring_index(x, "|", 2) != x))  # lines with two bars
    barred = F.contains(md, F.lit("|")) & ((rows >= 2) | F.contains(F.replace(md, F.lit(" "), F.lit("")), F.lit("|--")))
    flags["has_table"] = barred | F.contains(fold(raw, ascii_only), F.lit("<table"))
    flags["has_bullets"] = F.exists(lines(md), lambda x: x.rlike(r"^\s*([-*•]|\d+[.)])\s+"))
    flags["has_many_headings"] = F.size(headings(md) if heads is None else heads) >= 5
    flags["title_contains_intent_terms"] = intent_in_title(title, intent, ascii_only)
    return {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}


def intent_in_title(title: Column, intent: Column, ascii_only: bool = False) -> Column:
    """Does the title have a word of the intent's name that is not a generic one?"""
    names = F.array_except(F.regexp_extract_all(fold(intent, ascii_only), F.lit("[a-z]{3,}"), F.lit(0)), F.array(*map(F.lit, GENERIC_INTENT)))
    words = F.regexp_extract_all(fold(title, ascii_only), F.lit("[a-z0-9]+"), F.lit(0))
    return F.coalesce(F.arrays_overlap(names, words), F.lit(False))


def page_type(url: Column, kind: Column, flags: dict[str, Column]) -> Column:
    path = F.lower(F.coalesce(url, F.lit("")))
    rule = F.when(kind == "forum", "forum_thread").when(kind == "review", "review_page").when(kind == "news", "news_page")
    rule = rule.when((kind == "ecommerce") & _any(path, MARKET_WORDS), "marketplace_page").when(kind == "ecommerce", "product_page")
    for label, words, flag in PATH_TYPES:
        rule = rule.when(_any(path, words) | (flags[flag] if flag else F.lit(False)), label)
    rule = rule.when(flags["has_faq"], "faq_page").when(flags["has_booking_or_appointment"], "appointment_page")
    return rule.when(flags["has_author"] | flags["has_published_date"], "article").otherwise("unknown")


__all__ = ["LINE_END", "brand_candidate", "content_flags", "detect_terms", "institutional", "page_type", "source_type"]
