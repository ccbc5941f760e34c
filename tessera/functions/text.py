"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Han range, white space, sentence ends, accent folding (each letter and its plain form), organisation suffixes.
HAN = r"\x{4e00}-\x{9fff}"
SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TRIM = rf"^{SPACE}|{SPACE}$"
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
ORG_SUFFIXES = "公司|集团|银行|研究院|大学|中心|部"
CITATION = r"\[\[[^\]]+\]\]|[(（][^()（）]*#[^()（）]*[)）]"
WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_han(x) -> Column:
    return col(x).rlike(f"[{HAN}]")


def pad_han(x) -> Column:
    """A space on both sides of each Han character."""
    return F.regexp_replace(col(x), f"([{HAN}])", " $1 ")


def fold(x) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(col(x)), FOLD_FROM, FOLD_TO)


def tokens(x) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(x), F.lit(TOKEN), F.lit(0))


def mirrored(x) -> Column:
    """The text as the index holds it: as it is, and once more with Han characters apart."""
    return F.concat(col(x), F.lit(" "), pad_han(x))


def squeezed(x) -> Column:
    return F.trim(F.regexp_replace(col(x), SPACE, " "))


def content_hash(x) -> Column:
    """First 16 hexadecimal digits of the sha256 of the text with white space collapsed."""
    return F.substring(F.sha2(squeezed(x).cast("binary"), 256), 1, 16)


def slug(x) -> Column:
    """Everything but letters and digits becomes a hyphen, one for one; hyphens at the ends go; empty is `entity`."""
    s = F.lower(F.regexp_replace(F.regexp_replace(col(x), r"[^\p{L}\p{N}]", "-"), r"^-+|-+$", ""))
    return F.when(s == "", F.lit("entity")).otherwise(s)


def sentences(x) -> Column:
    """Pieces after 。！？；!?; and between lines; a full stop doesn't end one."""
    return F.filter(F.transform(F.split(col(x), r"(?<=[。！？；!?;])\s*|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def brief_sentences(x, n: int) -> Column:
    """The first n pieces, where a full stop ends one too."""
    return F.slice(F.filter(F.transform(F.split(col(x), r"(?<=[。！？；!?;.])\s*|\n+"), lambda s: F.trim(s)), lambda s: s != ""), 1, n)


def summary(pieces, limit: int = 280) -> Column:
    """Pieces appended as long as the budget of characters holds."""
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))

    def add(a, p):
        over = a["full"] | (F.length(a["t"]) + F.length(p) > limit)
        return F.struct(F.when(over, a["t"]).otherwise(F.concat(a["t"], p, F.lit(" "))).alias("t"), over.alias("full"))

    return F.trim(F.aggregate(pieces, start, add, lambda a: a["t"]))


def block_type(x) -> Column:
    """table: holds a pipe; list: every line is a bullet or numbered; else paragraph."""
    lines = F.split(col(x), "\n")
    item = F.forall(lines, lambda s: s.rlike(r"^[-*+] ") | (s.rlike(r"^[0-9]") & s.contains(". ")))
    return F.when(col(x).contains("|"), "table").when(item, "list").otherwise("paragraph")


def wikilinks(x) -> Column:
    return F.transform(F.regexp_extract_all(col(x), F.lit(WIKILINK), F.lit(1)), lambda s: F.trim(s))


def has_citation(x) -> Column:
    return col(x).rlike(CITATION)


def is_refusal(x) -> Column:
    from tessera.schema import REFUSAL

    return col(x).contains(REFUSAL)


def numbers(x) -> Column:
    return F.regexp_extract_all(col(x), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def judge(claim, evidence) -> Column:
    """unknown without numerals on a side; entailed by any shared numeral; else contradicted."""
    a, b = numbers(claim), numbers(evidence)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "unknown").when(F.arrays_overlap(a, b), "entailed").otherwise("contradicted")


def page_key(x) -> Column:
    """Slashes forward, a leading ./ and wiki/ stripped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(x), r"\\", "/"), r"^(\./)+", ""), "^wiki/", "")


def edge_multiplier(confidence) -> Column:
    from tessera.schema import CONFIDENCE

    c = F.lit(0.0)
    for k, v in CONFIDENCE.items():
        c = F.when(col(confidence) == k, F.lit(v)).otherwise(c)
    return c


def next_rung(confidence, verified) -> Column:
    """One rung up where a verification stands; high stays."""
    c = col(confidence)
    return F.when(~col(verified), c).when(c == "draft", "medium").when(c == "medium", "high").otherwise(c)


def disposition(state, stale, high_risk) -> Column:
    return F.when(col(state) == "retracted", "hard_filter").when(col(state) == "superseded", "filtered_unless_explicit_history").when(col(stale) & col(high_risk), "refuse_or_recompile").when(col(stale), "downrank_and_async_recompile").otherwise("use")


def expired(ttl, valid_from, today) -> Column:
    """Whether more days than the time to live (digits, maybe with a d) have passed."""
    days = F.regexp_extract(col(ttl), r"^([0-9]+)d?$", 1)
    return (days != "") & (F.datediff(today, F.to_date(col(valid_from))) > days.cast("int"))


def instruction_language(x) -> Column:
    """zh where more Han characters (with extension A) than ASCII letters stand in a query, else en."""
    han = F.length(F.regexp_replace(col(x), r"[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]", ""))
    return F.when(han > F.length(F.regexp_replace(col(x), "[^A-Za-z]", "")), "zh").otherwise("en")


def query_terms(query: str) -> list[str]:
    """Runs of letters and digits of a query."""
    return re.findall(r"[^\W_]+", query)


def _han(c: str) -> bool:
    return "一" <= c <= "鿿"


def folded(term: str) -> str:
    return term.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def phrases(query: str, limit: int = 32) -> list[list[str]]:
    """A term that holds Han characters is the phrase of its characters; others are single tokens."""
    return [[folded(c) for c in t] if any(map(_han, t)) else [folded(t)] for t in query_terms(query)][:limit]


def single_terms(query: str, limit: int = 64) -> list[str]:
    """Han characters and other terms one by one."""
    out: list[str] = []
    for t in query_terms(query):
        out += list(t) if any(map(_han, t)) else [t]
    return out[:limit]


def term_present(text, term: str) -> Column:
    """Latin: contained; Han: any pair of neighbours contained, or all characters of a term shorter than four."""
    t = col(text)
    if not any(map(_han, term)):
        return t.contains(term)
    pairs = [term[i : i + 2] for i in range(len(term) - 1)]
    hit = F.lit(False)
    for p in pairs:
        hit = hit | t.contains(p)
    if len(term) < 4:
        every = F.lit(True)
        for c in term:
            every = every & t.contains(c)
        hit = hit | every
    return hit
