"""Extraction from pages, captions, questions and uploaded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels, intents in their order, and synonyms.
CAPTION_LABELS = {"date": r"DATE", "address": r"ADDRESS", "market": r"MARKET", "buyer": r"BUYER", "seller": r"SELLER", "price": r"SALE\s+PRICE", "units": r"UNITS", "landlord": r"LANDLORD", "tenant": r"TENANT", "lender": r"LENDER"}


def caption_value(text: Column, label: str) -> Column:
    """The rest of the first line labelled so."""
    value = F.trim(F.regexp_extract(text, rf"(?i)(?:^|\n)\s*{label}\s*:\s*([^\n]+)", 1))
    return F.when(value != "", value)


def title_parties(title: Column) -> Column:
    """struct(buyer, seller) of "X buys ... from Y" or "X sells ... to Y"."""
    lead = F.trim(F.regexp_extract(title, r"(?is)^(.*?)\b(?:acquires?|buys?|purchases?|sells?)\b", 1))
    verb = F.lower(F.regexp_extract(title, r"(?i)\b(acquires?|buys?|purchases?|sells?)\b", 1))
    sells = verb.startswith("sell")
    other = F.when(sells, F.regexp_extract(title, r"(?i)\bto\s+(.+)$", 1)).otherwise(F.regexp_extract(title, r"(?i)\bfrom\s+(.+)$", 1))
    other = F.trim(F.regexp_replace(other, r"(?i)\s+(for|in|at|with|represented)\b.*$", ""))
    lead, other = F.when(lead != "", lead), F.when(other != "", other)
    known = lead.isNotNull() & (verb != "")
    return F.struct(F.when(known, F.when(sells, other).otherwise(lead)).alias("buyer"), F.when(known, F.when(sells, lead).otherwise(other)).alias("seller"))


def clean_party(c: Column) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[\s,;:]+$", ""))
    headline = text.rlike(r"(?i)\b(sells?|site|nearly|building)\b") & ~text.rlike(r"(?i)\b(LLC|INC|LP|CORP|TRUST|GROUP|REALTY|CAPITAL|PARTNERS)\b")
    return F.when((text != "") & ~headline, text)


# Fixed values.
INTENTS = [
    ("find_similar_buyers", r"\b(best|ideal|likely|recommended|top)\b.*\bbuyer|\bbuyer\b.*\bfor\b"),
    ("buyer_leaderboard", r"\b(top|active|most active)\b.*\bbuyers?\b|\bbuyer leaderboard\b"),
    ("lookup_contact", r"\b(phone|email|contact|cell|telephone)\b"),
    ("last_interaction", r"\b(last|when)\b.*\b(contact|talk|call|email|spoke|interaction)\b"),
    ("entity_history", r"\b(history|deals did|bought|sold|transactions for)\b"),
    ("similar_sellers", r"\b(sellers?|owners?)\b.*\b(similar|comparable|target|prospect)\b"),
    ("missing_contacts", r"\b(missing|no)\b.*\b(contact|phone|email)\b|\bcontact gaps?\b"),
    ("recent_changes", r"\b(recent changes?|newly added|updated)\b"),
    ("recent_deals", r"\b(recent|latest|show|find)\b.*\b(deals?|transactions?|sales?)\b"),
]


def question_intent(text: Column) -> Column:
    """The first rule's tool; null where none speaks."""
    q = F.lower(text)
    return F.coalesce(*[F.when(q.rlike(pattern), tool) for tool, pattern in INTENTS])


def question_price(text: Column) -> Column:
    """The first number with its unit; without a unit, only from 100,000 on."""
    pattern = r"(?i)\$?([0-9]+(?:\.[0-9]+)?)\s*(billion|bn|b|million|mm|m|thousand|k)?\b"
    n, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(text, pattern, 2))
    scale = F.when(unit.isin("billion", "bn", "b"), 1e9).when(unit.isin("million", "mm", "m"), 1e6).when(unit.isin("thousand", "k"), 1e3)
    return F.coalesce(n * scale, F.when(n >= 100000, n))


#: Words that say nothing as keywords.
SKIPPED = ["buyer", "best", "around", "property", "building", "million", "brooklyn", "manhattan", "queens", "bronx", "multifamily", "office", "retail", "industrial"]


def question_days(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)(?:last|past)\s+(\d+)\s+days?", 1).try_cast("int")


def question_keywords(text: Column, most: int = 6) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", " "), r"\s+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(SKIPPED))), 1, most)


def page_links(pages: DataFrame, pattern: str = r'href="([^"#]+)"') -> DataFrame:
    """(page_id, pos, link): each page's distinct links at their first places."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("pos", "link"))
    return each.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


# Fixed values.
SYNONYMS = {
    "entity_name": ["owner", "entity", "company", "buyer", "seller", "name", "llc", "borrower", "landlord"],
    "person_name": ["contact", "contact_name", "person", "principal", "rep", "broker"],
    "phone": ["phone", "tel", "telephone", "mobile", "cell", "phone_number"],
    "email": ["email", "e_mail", "mail", "email_address"],
    "mailing_address": ["address", "mailing", "mailing_address", "street", "location"],
    "title": ["title", "role", "position"],
    "last_contact_date": ["last_contact", "last_contacted", "last_contact_date", "contacted_on", "date"],
    "interaction_notes": ["notes", "note", "comment", "comments", "remarks"],
    "channel": ["channel", "method", "via"],
}


def sniff_mapping(headers: DataFrame, exact: bool = False) -> DataFrame:
    """headers (name) -> (name, field, score): an exact synonym 3, a synonym phrase inside 2, a synonym token 1; the best field of each header, the first listed of
    equals. The synonyms are a fixed short list, so they are broadcast."""
    spark = headers.sparkSession
    rows = [(i, f, s) for i, (f, ss) in enumerate(SYNONYMS.items()) for s in [f, *ss]]
    table = spark.createDataFrame(rows, "ord int, field string, synonym string")
    norm = F.regexp_replace(F.lower(F.trim("name")), "[ -]", "_")
    keyed = headers.select("name", norm.alias("norm"))
    # Every synonym that a header can contain is one of its runs of tokens: an equi-join instead of a comparison of all with all.
    tokens = F.split("norm", "_")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(tokens) - i + 1)), lambda n: F.array_join(F.slice(tokens, i, n), "_"))))
    met = keyed.withColumn("synonym", F.explode(F.array_distinct(runs))).join(F.broadcast(table), "synonym")
    score = F.when(F.col("norm") == F.col("synonym"), 3).when(F.col("synonym").contains("_"), 2).otherwise(1)
    met = met.withColumn("score", score).filter(F.col("score") == 3 if exact else F.lit(True))
    w = Window.partitionBy("name").orderBy(F.col("score").desc(), "ord")
    return met.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("name", "field", "score")
