"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from patterns: four base kinds (email, ip, card, phone), whose matches always stay when
their check holds, and two more (secret, phone_local), loose on purpose, that only the method can add. Labelers vote on
every candidate: a strict pattern, a gazetteer (top-level domains, country codes, issuer digits, area codes, key
prefixes and digest lengths), cue words for and against on both sides, the characters around it, and how varied its own
characters are. Expectation-maximisation on the counts of vote patterns (at most ``6 * 2 * 2 * 3 * 3 * 2``)
estimates each labeler's reliability and each pattern's posterior. The final span classifier, a logistic model,
never sees the votes: it learns the posteriors from the span itself (length, share of digits and capitals, variety,
neighbours, each in a few classes) and so also judges spans whose labelers abstain or err.
The driver gets one count for each set of votes and classes that occurs, of at most half a million possible ones.

The texts are scanned once: candidates are written with the other columns and read again, for the counts and the result.
Positions: a text split at the matches gives the gaps between them, whose lengths add up to code-point offsets. Sums run
over blocks of ``BLOCK`` matches and then over the blocks, so a text with very many matches takes no quadratic time.
The patterns are written without nested repetition, so long runs neither recurse nor backtrack.

Defined results: a null or empty text has no spans; repeated rows get the same result each; added spans that
overlap a base span are dropped; rows without id are kept; an empty table gives an empty result; the operator adds one
column to any table and reads only the text; where the table has a column of that name, ``spans`` says so in an error and
``redacted`` takes another name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, private, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "phone_local")
#: The patterns of the base kinds, equal in matches to their plain forms, and of the added candidates.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])[0-9A-Za-z_-]{16,}+",
    "phone_local": r"(?<![0-9A-Za-z+-])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z-])",
}
#: What a text must hold for a kind to match at all: found in one quick scan, or by a character.
NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){12}",
    "phone": "+",
    "secret": r"[0-9A-Za-z_-]{16}",
    "phone_local": r"[0-9]{3}[ .-]?[0-9]{4}",
}
#: Gazetteers and cues, as patterns on the span and on the text around it.
GAZETTEER = {
    "email": r"\.(com|org|net|edu|gov|mil|int|io|ai|co|dev|app|info|biz|de|fr|es|it|nl|be|pl|pt|se|no|dk|fi|cz|gr|ie|at|ch|uk|eu|us|ca|mx|br|ar|in|cn|jp|kr|au|nz|za|ru|tr)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|3[068]|35|6)",
    "phone": r"^\+(1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
    "secret": r"^(sk|pk|rk|ghp|gho|ghs|glpat|xox[abps]|AKIA|ASIA|AIza|ya29|eyJ)|^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40})$",
    "phone_local": r"^\(?([2-9][0-8][0-9])\)?[ .-]?[2-9]",
}
_PHONE = r"(?i)\b(phone|tel|call|mobile|cell|fax|dial|ring|telefon|telefono|teléfono|téléphone|handy|anruf)\W*$"
CUES = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|from|to|cc|address|adresse|correo|courriel|kontakt)\W*$",
    "ip": r"(?i)\b(ip|host|server|address|addr|client|remote|gateway)\W*$",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)( (no|number|nr))?\W*$",
    "phone": _PHONE,
    "secret": r"(?i)(key|token|secret|password|passwd|pwd|auth|bearer|credential|signature)\W*$",
    "phone_local": _PHONE,
}
AGAINST = r"(?i)\b(isbn|issn|doi|order|invoice|version|page|pages|seite|número|numéro|commit|sha|md5|checksum|part|sku|lot|year)( (no|nr|number))?[\W_]*$"
UNITS = r"(?i)^\W{0,2}(eur|usd|euro|euros|dollars|kg|km|pages|seiten|items|bytes|%)"
CONTEXT = 24
#: Matches that are added up at a time.
BLOCK = 256
_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, add, zero: int = 0) -> Column:
    """For each of an array's ints what ``add`` (a sum, a maximum) makes of those before it; linear but for BLOCK."""

    def scan(part: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("got"))
        step = lambda acc, x: F.struct(add(acc["at"], x).cast("int").alias("at"), F.array_append(acc["got"], acc["at"]).cast("array<int>").alias("got"))
        return F.aggregate(part, start, step, lambda acc: acc["got"])

    def over(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), lambda a, x: add(a, x).cast("int")))
        return F.flatten(F.zip_with(parts, scan(whole, F.lit(zero)), scan))

    def blocks(own: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), ((F.size(own) - 1) / BLOCK).cast("int")), lambda i: F.slice(own, i * BLOCK + 1, F.lit(BLOCK))), over)

    return let(values, lambda own: F.when(F.size(own) == 0, F.array().cast("array<int>")).otherwise(blocks(own)))


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind, leftmost and non-overlapping, as structs (start, end, value, before, after)."""
    pattern = PATTERNS[kind]

    def located(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["h"])), x["h"], lambda gap, hit: F.char_length(gap) + F.char_length(hit))
        gaps = F.arrays_zip(F.slice(x["g"], F.lit(1), F.size(x["h"])).alias("gap"), F.slice(x["g"], F.lit(2), F.size(x["h"])).alias("next"), running(sizes, lambda a, b: a + b).alias("at"))

        def span(g: Column, hit: Column) -> Column:
            start = g["at"] + F.char_length(g["gap"])
            return F.struct(start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("value"), F.right(g["gap"], F.lit(CONTEXT)).alias("before"), F.left(g["next"], F.lit(CONTEXT)).alias("after"))

        return F.zip_with(gaps, x["h"], span).cast(_SPAN)

    split = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))
    need = NEEDS[kind]
    there = F.contains(text, F.lit(need)) if len(need) == 1 else text.rlike(need)
    return F.when(there, let(split, located)).otherwise(F.array().cast(_SPAN))


def _valid(kind: str, value: Column) -> Column:
    """Whether a match counts: the checks that follow the patterns."""
    if kind == "ip":
        plain = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        back = F.reverse(F.regexp_replace(value, "[ -]", ""))
        digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
        luhn = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise((digit(i) * 2) % 10 + F.floor(digit(i) / 5).cast("int")))
        return luhn % 10 == 0
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _votes(kind: str, s: Column) -> Column:
    """The vote pattern: kind, then a 1 (yes), 0 (no) or - (abstains) from each labeler."""
    yes = lambda c, no="0": F.when(c, "1").otherwise(no)
    strict = {
        "secret": yes(s["value"].rlike(r"^[0-9a-fA-F]{32,}$|^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9].*[0-9])[0-9A-Za-z]{20,}$")),
        "phone_local": yes(s["value"].rlike(r"^\([0-9]{3}\) |^[0-9]{3}([ .-])[0-9]{3}\1")),
    }.get(kind, F.lit("1"))
    cue = F.when(s["before"].rlike(CUES[kind]), "1").when(s["before"].rlike(AGAINST) | s["after"].rlike(UNITS), "0").otherwise("-")
    quoted = s["before"].rlike(r"[\"'`=:<(\[]\s?$") & s["after"].rlike(r"^([\"'`>)\],;]|\s|$)")
    torn = s["before"].rlike(r"[\w/.#%&?-]$") | s["after"].rlike(r"^[\w/#%&=@-]")
    around = F.when(quoted, "1").when(torn, "0").otherwise("-")
    return F.concat_ws("", F.lit(kind + ":"), strict, yes(s["value"].rlike(GAZETTEER[kind])), cue, around, yes(_variety(s["value"]) >= (10 if kind == "secret" else 4)))


def _variety(value: Column) -> Column:
    """Distinct characters of a span's first 64."""
    return F.size(F.array_distinct(F.split(F.left(value, F.lit(64)), "")))


def _classes(kind: str, s: Column) -> Column:
    """What the classifier sees of a span: one class of each feature."""
    value, size = s["value"], F.char_length(s["value"])
    share = lambda pattern, n: F.least(F.floor(n * F.char_length(F.regexp_replace(value, pattern, "")) / size), F.lit(n - 1)).cast("int")
    side = lambda text, last: F.when(text == "", "end").when(text.rlike(r"\s$" if last else r"^\s"), "space").when(text.rlike(r"\w$" if last else r"^\w"), "word").otherwise("mark")
    named = {
        "size": F.least(F.floor(F.log2(size.cast("double"))).cast("int"), F.lit(6)),
        "digits": share("[^0-9]", 4),
        "capitals": share("[^A-Z]", 3),
        "variety": F.least(F.floor(_variety(value) / 6), F.lit(3)).cast("int"),
        "before": side(s["before"], True),
        "after": side(s["after"], False),
    }
    return F.array(*(F.concat(F.lit(f"{kind}:{n}="), c.cast("string")) for n, c in named.items()))


def _named(text: Column, kind: str, rank: int) -> Column:
    kept = F.filter(_matches(text, kind), lambda s: _valid(kind, s["value"]))
    return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), _votes(kind, s).alias("votes"), _classes(kind, s).alias("classes")))


def candidates(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: an array of (kind, rank, start, end, votes, classes) of the base spans and the candidates."""
    if private(docs, out) != out:
        raise ValueError(f"the table has a column {out}: name another one")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(out, F.concat(*(_named(text, kind, rank) for rank, kind in enumerate((*BASE, *ADDED)))))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def estimate(counts: dict[str, int], post: dict[str, float]) -> tuple[dict[str, float], list[float], list[float]]:
    """Each kind's share of true spans and each labeler's rate of yes on true and on false ones, given the posteriors.

    The rates have Beta priors (2, 2), (3, 2) and (2, 3): labelers are better than chance before any data.
    """
    prior = {}
    for k in {p.split(":")[0] for p in counts}:
        own = [p for p in counts if p.startswith(k + ":")]
        prior[k] = (sum(counts[p] * post[p] for p in own) + 1) / (sum(counts[p] for p in own) + 2)
    votes = {p: p.split(":")[1] for p in counts}
    hit, false = [], []
    for j in range(max(map(len, votes.values()), default=0)):
        said = [p for p in counts if votes[p][j] != "-"]
        pos, neg = sum(counts[p] * post[p] for p in said), sum(counts[p] * (1 - post[p]) for p in said)
        hit.append((sum(counts[p] * post[p] for p in said if votes[p][j] == "1") + 2) / (pos + 3))
        false.append((sum(counts[p] * (1 - post[p]) for p in said if votes[p][j] == "1") + 1) / (neg + 3))
    return prior, hit, false


def odds(pattern: str, prior: dict[str, float], hit: list[float], false: list[float]) -> float:
    """The log odds that a span with this vote pattern is true; labelers are independent given the truth."""
    kind, votes = pattern.split(":")
    out = math.log(prior[kind] / (1 - prior[kind]))
    for x, h, f in zip(votes, hit, false, strict=True):
        if x != "-":
            out += math.log(h / f) if x == "1" else math.log((1 - h) / (1 - f))
    return out


def reliabilities(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Each vote pattern's posterior by expectation-maximisation, from the share of yes among its votes."""
    votes = {p: p.split(":")[1] for p in counts}
    post = {p: (v.count("1") + 0.5) / (v.count("1") + v.count("0") + 1) for p, v in votes.items()}
    for _ in range(rounds):
        rates = estimate(counts, post)
        post = {p: _sigmoid(odds(p, *rates)) for p in counts}
    return post


def classifier(rows: dict[tuple[str, tuple[str, ...]], int], post: dict[str, float], rounds: int = 400, rate: float = 0.5, l2: float = 1e-3) -> dict[str, float]:
    """A logistic model's weight of each class, trained on the posteriors of ``rows`` (vote pattern, classes) -> count."""
    goal: dict[tuple[str, ...], list[float]] = {}
    for (votes, classes), n in rows.items():
        own = goal.setdefault((votes.split(":")[0], *classes), [0.0, 0.0])
        own[0] += n
        own[1] += n * post[votes]
    w = dict.fromkeys({f for fs in goal for f in fs}, 0.0)
    each = {k: max(1.0, sum(n for fs, (n, _) in goal.items() if fs[0] == k)) for k in {fs[0] for fs in goal}}
    for _ in range(rounds):
        grad = {f: l2 * v for f, v in w.items()}
        for fs, (n, yes) in goal.items():
            g = math.sqrt(n / each[fs[0]]) * (_sigmoid(sum(w[f] for f in fs)) - yes / n)  # the square root lets rare spans count
            for f in fs:
                grad[f] += g
        for f in w:
            w[f] -= rate * grad[f]
    return w


def learn(found: DataFrame, out: str = "pii") -> dict[str, float]:
    """The classifier's weights from the whole table's candidates."""
    rows = found.select(F.explode(out).alias("s")).groupBy("s.votes", "s.classes").count().collect()
    seen = {(r.votes, tuple(r.classes)): r["count"] for r in rows}
    counts: dict[str, int] = {}
    for (votes, _), n in seen.items():
        counts[votes] = counts.get(votes, 0) + n
    return classifier(seen, reliabilities(counts))


def _decided(found: DataFrame, out: str, least: float) -> DataFrame:
    """Written candidates with only the base spans and the added ones that the classifier takes, as (kind, rank, start, end)."""
    weights = {f: w for f, w in learn(found, out).items() if f.split(":")[0] in ADDED}
    base = F.filter(out, lambda s: s["rank"] < len(BASE))
    if weights:
        table = F.create_map(*(F.lit(x) for f, w in sorted(weights.items()) for x in (f, w)))
        weight = lambda f: F.coalesce(F.try_element_at(table, f), F.lit(0.0))
        score = lambda s: F.aggregate(s["classes"], weight(s["kind"]), lambda a, f: a + weight(f))
        yes = F.filter(out, lambda s: (s["rank"] >= len(BASE)) & (score(s) >= math.log(least / (1 - least))))
        added = let(base, lambda own: F.filter(yes, lambda s: ~F.exists(own, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
        base = F.concat(base, added)
    return found.withColumn(out, F.transform(base, lambda s: F.struct(s["kind"], s["rank"], s["start"], s["end"])))


def spans(docs: DataFrame, text_col: str = "text", out: str = "pii", least: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``out``: the base spans and the added ones, by kind as listed, then start; without the text if asked."""
    found = candidates(docs, text_col, out)
    return _decided(materialise(found if keep_text else found.drop(text_col), "candidates"), out, least)


_CHUNK = 1024


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; overlapping spans count as one."""
    out = private(docs, "pii")
    found = spans(docs, text_col, out)

    def cut(chunks: Column, lo: Column, hi: Column) -> Column:
        """The code points [lo, hi) of a text in chunks: a long text is not counted through for every span."""
        i, j = (lo / _CHUNK).cast("int"), (hi / _CHUNK).cast("int")
        part = lambda k, a, n: F.substring(F.coalesce(F.get(chunks, k), F.lit("")), a + 1, n)
        across = F.concat(part(i, lo % _CHUNK, F.lit(_CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), part(j, F.lit(0), hi % _CHUNK))
        return F.when(hi <= lo, "").when(i == j, part(i, lo % _CHUNK, hi - lo)).otherwise(across)

    def built(x: Column) -> Column:
        def piece(s: Column, done: Column) -> Column:
            return F.when(s["start"] < done, "").otherwise(F.concat(cut(x["chunks"], done, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))

        ends = F.transform(x["spans"], lambda s: s["end"])
        return F.concat(F.array_join(F.zip_with(x["spans"], running(ends, F.greatest), piece), ""), cut(x["chunks"], F.array_max(ends), F.lit(2**31 - 1 - _CHUNK)))

    ordered = F.sort_array(F.transform(out, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    chunks = F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    new = F.when(F.size(out) > 0, let(F.struct(ordered.alias("spans"), chunks.alias("chunks")), built)).otherwise(F.col(text_col))
    return found.withColumn(text_col, new).select(*docs.columns)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    said = lambda keep: F.array_join(F.transform(F.filter("pii", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    many = [F.size(F.filter("pii", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(BASE)]
    return found.select("doc_id", *many, F.sha2(said(lambda s: s["rank"] < len(BASE)), 256).alias("base_sha256"), said(lambda s: F.lit(True)).alias("spans"))
