"""Personal data by proposal, proof and context; DataFrame functions only.

Regular expressions propose spans. Validators confirm them: Luhn for card numbers, mod-97
for IBANs, part and digit counts for addresses and phone numbers; a failing match is
dropped and not retried. Every span gets a score by its kind, raised by context words in
the 40 characters before it, as far as these are not another match of the kind. Kinds `email`, `ip`, `card`, `phone` need no context; the
method adds `iban` (confirmed by its checksum) and `ssn`, a bare digit pattern that counts
only where a context word lifts its score from 0.3 to 0.5.

Positions come from one split per kind: its gaps and the matches between them have lengths, and
running sums of these are the offsets. Sums run in blocks, so a text with very many matches
takes time in proportion to n * sqrt(n) at most. One scan and projections; no shuffle.
The patterns match what their plain forms match, but never try a run twice: possessive
loops, and a look-behind that lets a run be entered at its start only (or where the match before ended).

Defined cases: a null or empty text has no spans; null doc_ids and repeated rows are kept;
an empty table gives an empty result; further columns are ignored (redact keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: A literal that every match has, so that texts without it are passed over.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
#: Characters that may not stand next to a match, nor another match of the kind.
APART = {"iban": "[A-Za-z0-9]", "ssn": "[0-9-]"}
#: Score without context, and the context words (lower case, in the languages of the corpus).
SCORE = {
    "email": (0.9, r"mail|contact|kontakt|correo|courriel"),
    "ip": (0.6, r"server|host|address|adresse"),
    "card": (0.8, r"card|visa|credit|karte|carte|tarjeta"),
    "phone": (0.6, r"phone|call|tel|fax|mobil|anruf|appel|llam"),
    "iban": (0.8, r"iban|account|konto|compte|cuenta"),
    "ssn": (0.3, r"ssn|social|security|sozial|seguro"),
}
CONTEXT = 0.2
_BLOCK = 512


def _scan(values: Column, start: Column) -> Column:
    """Running sums of an array of longs, each with start added."""
    first = F.struct(start.cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"] + x).alias("all"))
    return F.aggregate(values, first, step, lambda acc: acc["all"])


def running_sums(values: Column) -> Column:
    """Running sums, block by block: arrays are copied as they grow, so none grows long."""
    blocks = F.sequence(F.lit(0), F.greatest((F.size(values) - 1) / _BLOCK, F.lit(0)).cast("int"))
    part = lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))
    total = _scan(F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))
    long = F.flatten(F.zip_with(blocks, total, lambda b, t: _scan(part(b), t - F.aggregate(part(b), F.lit(0).cast("bigint"), lambda a, x: a + x))))
    return F.when(F.size(values) <= _BLOCK, _scan(values, F.lit(0))).otherwise(long)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    compact = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 1000), F.substring(compact, 1, 4))
    value = lambda c: F.when(c >= 65, c - 55).otherwise(c - 48)
    step = lambda a, c: F.when(c >= 65, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97)
    codes = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), step)


def _near(kind: str, gaps: Column, i: Column) -> Column:
    """Whether a context word stands in the gap before match i."""
    return F.lower(F.substring(F.element_at(gaps, i + 1), -40, 40)).rlike(SCORE[kind][1])


def valid(kind: str, m: Column, gaps: Column, i: Column) -> Column:
    """Whether match i, which follows gap i, is confirmed."""
    if kind in APART:
        before, after = F.element_at(gaps, i + 1), F.element_at(gaps, i + 2)
        alone = ~before.rlike(APART[kind] + "$") & ~after.rlike("^" + APART[kind]) & ((i == 0) | (before != ""))
        return alone & (_near(kind, gaps, i) if kind == "ssn" else _confirmed(kind, m))
    return _confirmed(kind, m)


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.length(_digits(m))
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    if kind == "card":
        return digits.between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return digits.between(10, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(m) == 1)
    return F.lit(True)


def _proposed(text: Column, kind: str) -> tuple[Column, Column]:
    """Gaps between the matches, and the matches; a text without the needed literal is one gap."""
    found = F.split(text, PATTERNS[kind], -1)
    return (F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array(text)) if NEEDS[kind] else found), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def _steps(gaps: Column, matches: Column) -> Column:
    return F.transform(matches, lambda m, i: (F.length(F.element_at(gaps, i + 1)) + F.length(m)).cast("bigint"))


def _spans(kind: str, gaps: Column, matches: Column, ends: Column) -> Column:
    def span(m: Column, i: Column) -> Column:
        end = F.element_at(ends, i + 1).cast("int")
        score = F.lit(SCORE[kind][0]) + F.when(_near(kind, gaps, i), F.lit(CONTEXT)).otherwise(F.lit(0.0))
        return F.struct((end - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"), valid(kind, m, gaps, i).alias("valid"))

    kept = F.filter(F.transform(matches, span), lambda s: s["valid"])
    return F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "score")]))


_EMPTY = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (start, rank of the kind, end, kind, score), in that order; offsets in
    code points, end exclusive."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.select("doc_id", "text", *[_proposed(F.col("text"), k)[0].alias(f"gaps_{k}") for k in KINDS])
    some = {k: F.size(f"gaps_{k}") > 1 for k in KINDS}
    none = F.array().cast("array<string>")
    out = out.select("doc_id", *[F.when(some[k], F.col(f"gaps_{k}")).otherwise(none).alias(f"gaps_{k}") for k in KINDS], *[F.when(some[k], _proposed(F.col("text"), k)[1]).otherwise(none).alias(f"is_{k}") for k in KINDS])
    out = out.select("*", *[_steps(F.col(f"gaps_{k}"), F.col(f"is_{k}")).alias(f"step_{k}") for k in KINDS])
    out = out.select("*", *[F.when(F.size(f"step_{k}") > 0, running_sums(F.col(f"step_{k}"))).otherwise(F.array().cast("array<bigint>")).alias(f"ends_{k}") for k in KINDS])
    each = [F.when(F.size(f"is_{k}") > 0, _spans(k, F.col(f"gaps_{k}"), F.col(f"is_{k}"), F.col(f"ends_{k}"))).otherwise(F.array().cast(_EMPTY)) for k in KINDS]
    return out.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digests(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans, and all spans as text."""
    out = find_pii(docs)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return out.select("doc_id", *map(count, BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


#: A kind whose matches take in those of a later one, where they overlap, comes before it.
MASK_ORDER = ("phone", "card", "iban", "ssn", "email", "ip")


def _masked(text: Column, gaps: Column, matches: Column, kind: str) -> Column:
    shown = F.transform(matches, lambda m, i: F.concat(F.element_at(gaps, i + 1), F.when(valid(kind, m, gaps, i), F.lit(f"[{kind.upper()}]")).otherwise(m)))
    return F.when(F.size(gaps) > 1, F.concat(F.array_join(shown, ""), F.element_at(gaps, -1))).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns; in text every confirmed span is replaced by its kind in brackets.
    Null texts stay null."""
    names = docs.columns
    text, gaps, matches = "__text", "__gaps", "__matches"
    out = docs.withColumn(text, F.col("text").cast("string"))
    for kind in MASK_ORDER:
        out = out.withColumn(gaps, _proposed(F.col(text), kind)[0])
        out = out.withColumn(matches, F.when(F.size(gaps) > 1, _proposed(F.col(text), kind)[1]))
        out = out.withColumn(text, _masked(F.col(text), F.col(gaps), F.col(matches), kind)).drop(gaps, matches)
    return out.select(*[F.col(text).alias("text") if n == "text" else F.col(f"`{n}`") for n in names])


def oracle() -> str:
    """pii_digests(documents) in DuckDB's SQL; its patterns need no guards, as its matcher takes linear time."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
    }
    proposed = " union all ".join(f"select rid, '{k}' kind, {r} rank, regexp_extract_all(t, '{plain.get(k, PATTERNS[k])}') ms, regexp_split_to_array(t, '{plain.get(k, PATTERNS[k])}') gaps from d" for r, k in enumerate(KINDS))
    apart = " ".join(f"when kind = '{k}' and (regexp_matches(g, '{c}$') or regexp_matches(after, '^{c}') or (i > 1 and g = '')) then false" for k, c in APART.items())
    return rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
proposed as ({proposed}),
each as (select rid, kind, rank, unnest(ms) m, unnest(gaps[:len(ms)]) g, unnest(gaps[2:]) after, generate_subscripts(ms, 1) i from proposed where len(ms) > 0),
placed as (select *, cast(sum(length(g) + length(m)) over (partition by rid, kind order by i) as bigint) e, regexp_replace(m, '[^0-9]', '', 'g') digits, replace(m, ' ', '') compact from each),
proven as (select *, case {apart}
  when kind = 'email' then true
  when kind = 'ip' then list_min([cast(length(ltrim(p, '0')) <= 3 and cast(right('000' || ltrim(p, '0'), 3) as int) <= 255 as int) for p in string_split(m, '.')]) = 1
  when kind = 'card' then length(digits) between 14 and 19 and list_sum([case when k % 2 = 0 then cast(digits[length(digits) - k] as int) else (2 * cast(digits[length(digits) - k] as int)) // 10 + (2 * cast(digits[length(digits) - k] as int)) % 10 end for k in range(length(digits))]) % 10 = 0
  when kind = 'phone' then length(digits) between 10 and 15
  when kind = 'iban' then length(compact) between 15 and 34 and list_reduce([0] || [case when c >= 'A' then ord(c) - 55 else ord(c) - 48 end for c in string_split(compact[5:] || compact[:4], '')], lambda a, x: case when x >= 10 then (a * 100 + x) % 97 else (a * 10 + x) % 97 end) = 1
  else regexp_matches(lower(right(g, 40)), '{SCORE["ssn"][1]}') end ok from placed),
spans as (select rid, kind, rank, e - length(m) s, kind || ':' || (e - length(m)) || ':' || e shown from proven where ok),
summed as (select rid, count(*) filter (where kind = 'email') n_email, count(*) filter (where kind = 'ip') n_ip, count(*) filter (where kind = 'card') n_card, count(*) filter (where kind = 'phone') n_phone,
  string_agg(shown, ',' order by s, rank) filter (where rank < {len(BASE)}) base, string_agg(shown, ',' order by s, rank) spans from spans group by rid)
select doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join summed using (rid)"""
