"""Scalar functions of the fact graph, as Column expressions (all run inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
HALF_LIFE_DAYS = {"status": 7, "todo": 14, "fact": 60, "decision": 120, "gotcha": 120, "preference": 365}
DEFAULT_HALF_LIFE_DAYS = 60
DECAY = 0.693
MASS_FLOOR = 0.05
RRF_K = 60
STOPWORDS = (
    "the and for with that this these those from into onto over under about after before between what when where which who whom whose why how "
    "does did do doing done is are was were be been being has have had can could should would will shall may might must you your yours we our ours "
    "they them their it its he she his her in on at to of as by an or if so no not but there here then than too very just also any all some"
).split()
HISTORICAL = (
    r"(?i)\b(as of|why did|how did|used to|back (then|when|in)|at the time|in (january|february|march|april|may|june|july|august|september|october|november|december|20\d\d))\b"
    r"|\b(was|were|did|had|history|historically|originally|previously|before|earlier|changed|evolved|timeline)\b"
)
CURRENT = r"(?i)\b(right now|as of (now|today)|at the moment|these days)\b|\b(currently|now|today|latest|current|status|still|anymore|nowadays)\b|\b(is|are)\b"
SECRET = (
    r"sk-[A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16}|xox[bap]-[A-Za-z0-9-]{10,}|ghp_[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{40,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{20,}"
    r"|(?i:(password|api[_-]?key|secret|token)\s*[=:]\s*)[^\s'\"]{8,}"
)
ABSTAIN_PREFIX = "LOW CONFIDENCE — likely not covered:"
DOUBT_MARKERS = [
    "unknown", "don't have", "do not have", "don't use", "do not use", "doesn't use", "don't appear", "does not appear", "not used", "no evidence",
    "not covered", "no fact", "no cited fact", "nothing in the", "no indication", "not in the graph", "graph does not contain", "no record", "no recorded",
    "not present", "not mentioned", "no mention", "did not have", "didn't have", "no decision", "found no", "couldn't find", "could not find", "nothing recorded",
    "not configured", "isn't configured", "can't verify", "cannot verify", "can't confirm", "cannot confirm", "can't find", "cannot find", "unable to find",
    "not set up", "don't run", "do not run", "not have", "don't find", "do not find", "no documented", "not documented", "not recorded",
]


def _d(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


# --- Mass and time.


def half_life_days(kind: Column) -> Column:
    out = F
    for name, days in HALF_LIFE_DAYS.items():
        out = out.when(kind == name, float(days))
    return out.otherwise(float(DEFAULT_HALF_LIFE_DAYS))


def decayed_mass(kind: Column, mass: Column, valid_from: Column, now) -> Column:
    return F.lit(MASS_FLOOR) + order_mass(kind, mass, valid_from, now)


def order_mass(kind: Column, mass: Column, valid_from: Column, now) -> Column:
    """Decayed mass without the floor: for ordering only."""
    age = F.greatest(F.lit(0.0), _d(now) - valid_from)
    return mass * F.exp(-DECAY * age / (half_life_days(kind) * 86400))


def is_stale(kind: Column, valid_from: Column, now) -> Column:
    return _d(now) - valid_from > 2 * half_life_days(kind) * 86400


def is_rotten(kind: Column, valid_from: Column, now) -> Column:
    return _d(now) - valid_from > 3 * half_life_days(kind) * 86400


def age_days(valid_from: Column, now) -> Column:
    return F.round((_d(now) - valid_from) / 8640) / 10


def epoch_day(t: Column) -> Column:
    """The UTC date of an epoch, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / 86400).cast("int"))


def epoch_date(t: Column) -> Column:
    return epoch_day(t).cast("string")


def rfc3339_epoch(s: Column) -> Column:
    """Whole epoch seconds; 0 where the text is no time."""
    return F.coalesce(F.unix_timestamp(s.try_cast("timestamp")).cast("double"), F.lit(0.0))


def iso_epoch(s: Column) -> Column:
    return F.datediff(s.try_cast("date"), F.lit("1970-01-01").cast("date")) * 86400.0


def observation_time(day: Column, valid_from: Column) -> Column:
    """When an observation happened: its own ISO date, else when its fact became true."""
    return F.coalesce(iso_epoch(day), valid_from)


def next_midnight(t: Column) -> Column:
    return (F.floor(t / 86400) + 1) * 86400.0


def era_midpoint(old: Column, new: Column) -> Column:
    return (old + new) / 2


def backoff_seconds(errors: Column) -> Column:
    return F.least(1800 * F.pow(F.lit(2.0), F.least(errors, F.lit(6))), F.lit(86400.0))


def temporal_intent(q: Column) -> Column:
    return F.when(q.rlike(HISTORICAL), "historical").when(q.rlike(CURRENT), "current").otherwise("neutral")


# --- Scores.


def rrf(rank: Column, weight: float = 1.0) -> Column:
    """weight / (60 + rank), 0 where there is no rank."""
    return F.coalesce(F.lit(float(weight)) / (RRF_K + rank), F.lit(0.0))


def corroborated(confidence: Column, times: Column) -> Column:
    """Confidence after so many independent restatements; one step is min(0.98, 1 - (1 - c) * 0.7)."""
    return F.when(times > 0, F.least(F.lit(0.98), 1 - (1 - confidence) * F.pow(F.lit(0.7), times))).otherwise(confidence)


def reinforced(mass: Column) -> Column:
    return F.least(mass + 0.15, F.lit(3.0))


def evidence_tier(evidence: Column) -> Column:
    return F.when(evidence == "verified", 1.0).when(evidence == "reported", 0.8).otherwise(0.6)


def retrieval_strength(tops: Column) -> Column:
    """Mean of min(top / 0.03, 1) over the top scores of the searches; 0 without any."""
    n = F.size(tops)
    return F.when(n > 0, F.aggregate(tops, F.lit(0.0), lambda a, x: a + F.least(x / 0.03, F.lit(1.0))) / n).otherwise(0.0)


def answer_confidence(coverage, validity, tier, agreement, retrieval, doubt) -> Column:
    score = 0.30 * coverage + 0.25 * validity + 0.20 * tier + 0.15 * agreement + 0.10 * retrieval
    return F.when(doubt, score * 0.4).otherwise(score)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double, over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    return bind(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def softmax(v: Column) -> Column:
    shifted = bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return bind(shifted, lambda e: bind(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total)))


def argmax(v: Column) -> Column:
    """0-based position of the greatest; the first of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def margin(v: Column) -> Column:
    s = F.sort_array(v, False)
    return F.get(s, 0) - F.get(s, 1)


# --- Text.


def stripped(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"[A-Za-z0-9_.-]{2,}"), F.lit(0))


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once, though ``use`` mentions it often or inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def query_tokens(s: Column, scanned: int = 64, kept: int = 12) -> Column:
    """The content tokens of a query: stopwords dropped, the first spelling of each kept; all tokens if none is left."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])

    def content(raw: Column) -> Column:
        pairs = F.transform(raw, lambda t: F.struct(t.alias("t"), F.lower(t).alias("l")))
        first = lambda ps: F.filter(ps, lambda p, i: ~F.array_contains(stop, p["l"]) & ~F.exists(F.slice(ps, 1, i), lambda o: o["l"] == p["l"]))
        picked = bind(pairs, lambda ps: F.transform(first(ps), lambda p: p["t"]))
        return bind(picked, lambda c: F.when(F.size(c) > 0, F.slice(c, 1, kept)).otherwise(F.slice(raw, 1, kept)))

    return bind(F.slice(tokens(s), 1, scanned), content)


def match_query(s: Column) -> Column:
    quoted = lambda t: F.array_join(F.transform(t, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")
    return bind(query_tokens(s), lambda t: F.when(F.size(t) > 0, quoted(t)).otherwise('""'))


def normalized_statement(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}]", "")


def statement_hash(s: Column) -> Column:
    return F.sha1(normalized_statement(s))


def canonical_name(s: Column) -> Column:
    return F.lower(F.trim(s))


def variant_key(s: Column) -> Column:
    return F.translate(F.lower(s), "-_. ", "")


def snake_name(s: Column) -> Column:
    return F.replace(F.trim(F.lower(s)), F.lit(" "), F.lit("_"))


def redacted(s: Column) -> Column:
    return F.regexp_replace(s, SECRET, "[REDACTED]")


def entity_name_ok(s: Column) -> Column:
    return (F.length(s) > 0) & (F.octet_length(s) <= 48) & ~s.rlike(r"[/\\`«»]") & (F.regexp_count(s, F.lit(" ")) <= 3)


def repo_name_ok(s: Column) -> Column:
    return F.coalesce(~s.isin("", ".", "/") & (F.octet_length(s) <= 40), F.lit(False))


def repo_of_cwd(cwd: Column) -> Column:
    base = F.regexp_extract(cwd, r"([^/]+)/*$", 1)
    return F.when(repo_name_ok(base), base).otherwise("unknown")


def repo_of_origin(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"\.git$", ""), r"([^/:]+)$", 1)


def citations(answer: Column) -> Column:
    """Distinct cited ids in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("bigint")))


def _has_doubt(s: Column) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in DOUBT_MARKERS]), lambda m: F.contains(s, m))


def leads_with_doubt(answer: Column) -> Column:
    low = F.trim(F.lower(F.replace(answer, F.lit("’"), F.lit("'"))))
    p = ABSTAIN_PREFIX.lower()
    lead = F.trim(F.when(F.startswith(low, F.lit(p)), F.substring(low, len(p) + 1, 1_000_000)).otherwise(low))
    return _has_doubt(F.left(lead, F.lit(160)))


def denies_coverage(answer: Column) -> Column:
    return _has_doubt(F.lower(F.replace(answer, F.lit("’"), F.lit("'"))))


def with_abstain(answer: Column, abstained: Column) -> Column:
    marked = F.startswith(F.trim(answer), F.lit(ABSTAIN_PREFIX))
    return F.when(abstained & ~marked, F.concat(F.lit(ABSTAIN_PREFIX + " "), F.trim(answer))).otherwise(answer)


def contains_all(statement: Column, keywords: Column) -> Column:
    return F.forall(keywords, lambda k: F.contains(F.lower(statement), F.lower(k)))


def clean_fact(df):
    """Extracted facts by the cleaning rules: kind, confidence, evidence, at most 12 entities and files."""
    valid = F.col("kind").isin(*HALF_LIFE_DAYS)
    conf = F.when((F.col("confidence") > 0) & (F.col("confidence") <= 1), F.col("confidence")).otherwise(0.7)
    evidence = F.when(F.col("evidence").isin("verified", "reported"), F.col("evidence")).otherwise("asserted")
    capped = F.when(evidence == "reported", F.least(conf, F.lit(0.6))).when(evidence == "asserted", F.least(conf, F.lit(0.8))).otherwise(conf)
    cut = {c: F.slice(c, 1, 12) for c in ("entities", "files")}
    return df.withColumns({"statement": redacted(F.trim("statement")), "kind": F.when(valid, F.col("kind")).otherwise("fact"), "confidence": capped, "evidence": evidence, **cut}).where("statement <> ''")


def fact_line(fact_id: Column, kind: Column, repo: Column, valid_from: Column, confidence: Column, statement: Column) -> Column:
    return F.format_string("[%d] (%s, %s, %s, %.2f) %s", fact_id, kind, repo, epoch_date(valid_from), confidence, statement)


def prompt_side(valid_from: Column, evidence: Column, kind: Column, statement: Column) -> Column:
    return F.format_string("[valid_from %s][evidence %s][kind %s] %s", epoch_date(valid_from), evidence, kind, statement)
