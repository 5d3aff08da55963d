"""Personal data: spans by fixed patterns, and more by boosted candidates, in DataFrame operations.

Generators propose overlapping spans with high recall: anything around an at sign or
its written forms, digit groups, and long mixed tokens.  Each candidate has format
features (digits, letters, groups, dots, brackets) and context features (how near a cue
word stands before it, assignments, quotes).  The tables hold no labels of personal
data, so labels are weak ones: validators, of which most check what no feature shows (a check
digit, the range of an octet, a host's last name, digits of an international number).
Boosted trees learn from the candidates of all rows, counted by their features, which ones look like
confirmed ones; a threshold calibrated on the half of the texts held out selects spans
besides those of the base patterns.

Offsets come from splitting a text at the matches of a pattern: pieces and matches
alternate, so their lengths add up to the places of the matches in code points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.boosting import Forest, fitted, threshold

#: Base patterns.  Possessive quantifiers and the look-behinds keep long runs linear
#: and change no match: a run that fails from its start fails from within.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What candidates look like: contacts, digit groups, mixed tokens.
GENERATORS = {
    "contact": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9.-]++",
    "number": r"\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "secret": r"(?:(?<![A-Za-z0-9_/+=-])|\G)[A-Za-z0-9_/+=-]{20,}+",
}
KINDS = (*PATTERNS, *GENERATORS)
#: Words that announce personal data, and the characters before a candidate that are read.
CUES, CONTEXT = r"(?i)(?:token|secret|key|passw|pin|tel|phone|call|fax|mail|card|iban|account|ip)\b", 32
#: The last of them and what follows it.
LAST_CUE = "(?is).*(" + CUES[7:-3] + r")\b(.*)$"
#: What ends right before a phone number, and a contact written without an at sign whose host ends in a dotted name.
PHONE_CUE = r"(?i)\b(?:tele)?(?:tel|phone|call|fax)(?:[\x20]?(?:no|number|us|me|at|on|is|or)\b)*[\x20]?[.:=#]?[\x20]?\(?$"
WRITTEN = r"[A-Za-z0-9] ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\.?$"
#: Held-out precision at which candidates become spans; matches of a text that are placed one after the other before their places are added up.
PRECISION, CHUNK = 0.95, 64
_FOUND = "array<struct<kind:string,start:int,end:int,match:string,before:string>>"


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost matches that do not overlap, with code-point spans and the text before each."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["h"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["h"].alias("match"), F.right(x["p"], F.lit(CONTEXT)).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.expr(f"cast(array() as {_FOUND})").alias("out")), step, lambda acc: acc["out"])

    # long lists in chunks: each starts where the lengths of those before add up to
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda i: F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)))
    lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x["p"]) + F.length(x["h"])))
    begins = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + n)))
    long = F.flatten(F.zip_with(chunks, F.slice(begins, 1, F.size(chunks)), placed))
    return F.when(F.size(pairs) <= CHUNK, placed(pairs, F.lit(0))).otherwise(long)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second one from the right doubled and cut to one digit's sum, add up to a multiple of ten."""
    turned = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.coalesce(_luhn(digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _features(c: Column) -> list[tuple[str, Column]]:
    match, before = c["match"], c["before"]

    def bucket(n: Column, *tops: int) -> Column:
        out = F.lit(len(tops))
        for i in reversed(range(len(tops))):
            out = F.when(n <= tops[i], i).otherwise(out)
        return out

    flag = lambda x: F.when(x, 1).otherwise(0)
    cue = F.lower(F.regexp_extract(before, LAST_CUE, 1))
    return [
        ("kind", bucket(F.array_position(F.array(*map(F.lit, GENERATORS)), c["kind"]), 1, 2)),
        ("digits", bucket(F.length(_digits(match)), 0, 6, 9, 12, 15, 19)),
        ("letters", bucket(F.length(F.regexp_replace(match, "[^A-Za-z]", "")), 0, 4, 15, 39)),
        ("groups", bucket(F.size(F.regexp_extract_all(match, F.lit("[A-Za-z0-9]+"), F.lit(0))), 1, 2, 4)),
        ("dots", bucket(F.length(F.regexp_replace(match, "[^.]", "")), 0, 1)),
        ("brackets", flag(match.rlike(r"[(\[]"))),
        ("cue", F.when(cue == "", 0).when(cue.isin("tel", "phone", "call", "fax"), 1).when(cue.isin("mail", "ip"), 2).when(cue.isin("card", "iban", "account"), 3).otherwise(4)),
        ("away", bucket(F.length(F.regexp_extract(before, LAST_CUE, 2)), 4, 8)),
        ("assigned", flag(before.rlike(r"[=:][\x20]?[\"']?$"))),
        ("quoted", flag(before.rlike("[\"']$"))),
    ]


def _confirmed(c: Column) -> Column:
    """Whether a validator confirms a candidate (a weak label): it holds a base match that passes, is a written-out address, has a phone number's digits right after a phone cue, or is a mixed token assigned to a cue."""
    match = c["match"]
    digits = _digits(match)
    return (
        match.rlike(PATTERNS["email"])
        | F.when(match.rlike("^" + PATTERNS["ip"] + "$"), _valid("ip", match)).otherwise(False)
        | F.when(match.startswith("+"), _valid("phone", match)).otherwise(False)
        | F.when(F.length(digits).between(16, 19) & match.rlike("^[0-9 -]+$"), _valid("card", match)).otherwise(False)
        | match.rlike(WRITTEN)
        | ((c["kind"] == "number") & F.length(digits).between(7, 15) & c["before"].rlike(PHONE_CUE))
        | (match.rlike("[0-9]") & match.rlike("[A-Za-z]") & c["before"].rlike(CUES[:-2] + r"[\x20]?[=:][\x20]?[\"']?$"))
    )


def _matched(docs: DataFrame, id_cols: list[str], text_col: str, base: bool) -> DataFrame:
    """half and candidates, or with `base` id_cols (as c0, c1, ...), the valid base spans and candidates."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(id_cols)), text.alias("_text")).withColumns({"_at": F.col("_text").contains("@") | F.col("_text").rlike(r"[(\[]at[)\]]"), "_digit": F.col("_text").rlike("[0-9]")})
    none = F.expr(f"cast(array() as {_FOUND})")
    gate = {"email": F.col("_at"), "contact": F.col("_at")}
    wanted = ({**PATTERNS, **GENERATORS} if base else GENERATORS).items()
    rows = rows.withColumns({f"_{k}": F.when(gate.get(k, F.col("_digit")), _found(F.col("_text"), k, p)).otherwise(none) for k, p in wanted})
    candidates = F.concat(*[F.col(f"_{k}") for k in GENERATORS])
    half = F.pmod(F.xxhash64("_text"), F.lit(2)).alias("half")
    if not base:
        return rows.select(half, candidates.alias("candidates"))
    kept = F.concat(*[F.filter(f"_{k}", (lambda k: lambda s: _valid(k, s["match"]))(k)) if k != "email" else F.col("_email") for k in PATTERNS])
    return rows.select(*(f"c{i}" for i in range(len(id_cols))), kept.alias("base"), candidates.alias("candidates"))


def learnt(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> tuple[Forest, float]:
    """The trees and the threshold, from counts over the candidates of all rows; half of the texts are held out for the threshold. The driver gets a row per combination of features, of which there are a fixed number."""
    c = _matched(docs, [], text_col, base=False).select("half", F.explode("candidates").alias("c"))
    features = _features(F.col("c"))
    names = [n for n, _ in features]
    counts = c.select("half", *[f.alias(n) for n, f in features], _confirmed(F.col("c")).alias("ok")).groupBy("half", *names).agg(F.count_if("ok").alias("p"), F.count_if(~F.col("ok")).alias("n")).orderBy("half", *names).collect()
    part = lambda h: (np.array([[r[n] for n in names] for r in counts if r.half == h], np.int64).reshape(-1, len(names)), np.array([r.p for r in counts if r.half == h], float), np.array([r.n for r in counts if r.half == h], float))
    x, p, n = part(0)
    forest = fitted(x, p, n)
    x, p, n = part(1)
    return forest, threshold(forest.scores(x), p, n, precision)


def spans(docs: DataFrame, id_cols: list[str], text_col: str = "text", model: tuple[Forest, float] | None = None) -> DataFrame:
    """id_cols, base and added of each row: arrays of (kind, start, end, match), ordered by kind as in KINDS, then start.

    `base` has the patterns' matches that pass; `added` the candidates from the
    threshold on that overlap no base span.  A null or empty text has no spans.
    Repeated rows each give a row; an empty table gives none.  Other columns are ignored;
    id_cols named base or added give way to these.
    """
    forest, least = model or learnt(docs, text_col)
    id_cols = [c for c in id_cols if c not in ("base", "added")]
    rows = _matched(docs, id_cols, text_col, base=True)
    if np.isfinite(least):
        chosen = F.filter("candidates", lambda c: (forest.column([f for _, f in _features(c)]) >= least) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    else:
        chosen = F.filter("candidates", lambda c: F.lit(False))
    tidy = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(id_cols)), tidy("base").alias("base"), tidy(chosen).alias("added"))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are merged, the first one names them."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, kept).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
