"""Personal data by candidate gradient boosting, in SQL expressions only.

Base spans follow fixed patterns and checks.  Beside them, high-recall generators propose overlapping
spans (written-out addresses, numbers without prefix, numbers inside longer runs); boosted trees rate each
by its format and context, a calibrated threshold for each kind selects, and overlaps go to the better.
The trees learn from sentences made of formats in this module, and are sent along as a CASE expression.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.boosting import Boosted
from undula.llm.common import Kept, named

KINDS = ("email", "ip", "card", "phone")
#: Share of accepted kept-back candidates that must be right; code points of context on either side.
PRECISION, CONTEXT = 0.98, 32

# The contract's patterns, with possessive quantifiers and starts that no earlier start makes useless:
# the same matches, in linear time.  \G is where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: Generators: kind, what a text must hold, pattern.  A pattern's matches don't overlap, those of different ones may.
GENERATORS = (
    ("email", r"(?i)[(\[{]\s?at\s?[)\]}]", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}){1,5}"),
    ("email", r"(?i)\x20at\x20|\x20@|@\x20", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\x20at\x20|@)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}){1,5}"),
    ("ip", r"[0-9]\x20?[(\[{]\x20?(?:\.|dot)", r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:[(\[{]\x20?(?:\.|dot)\x20?[)\]}]|\.)\x20?[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"[0-9]{4}", r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20./-]?[0-9]{4}){2}[\x20./-]?[0-9]{1,7}(?![0-9A-Za-z])"),
    ("card", r"[0-9]{12}", r"(?<![0-9A-Za-z])[0-9]{12,19}(?![0-9A-Za-z])"),
    ("phone", r"[0-9]{3}", r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)[\x20.-]?|00[0-9]{1,3}[\x20.-]?|[0-9]{2,5}[\x20./-])(?:[0-9]{2,5}[\x20.-]?){1,4}[0-9](?![0-9A-Za-z])"),
)
WORDS = (r"(?i)\b(?:tel|phone|call|mobile|cell|fax|whatsapp|text me|reach|dial)", r"(?i)\b(?:card|visa|master|amex|credit|debit|payment|charge)", r"(?i)\b(?:ip|host|server|address|login|from)\b", r"(?i)\b(?:mail|contact|write|reach|send)", r"(?i)\b(?:order|invoice|version|isbn|ref|id|no|build|ticket|serial|section)\b|[$#=]")


def found(text: str, pattern: str, needs: str) -> str:
    """SQL: (start, end, value, left, right) of all matches, in code points.

    The pieces between matches and the matches themselves, in turn, make up the text; their lengths
    give the places.  Lengths are summed in runs of 256, so that the cost stays near linear.
    """
    pieces, values = f"split({text}, r'{pattern}', -1)", f"regexp_extract_all({text}, r'{pattern}', 0)"
    sums = "aggregate({of}, struct(array() AS seen, {start} AS total), (s, x) -> struct(array_append(s.seen, s.total) AS seen, s.total + x AS total), s -> s.seen)"
    sums = sums.replace("array() AS seen", "cast(array() AS array<int>) AS seen")
    inner = sums.format(of="slice(lengths, 256 * b + 1, 256)", start="starts[b]")
    outer = sums.format(of="transform(sequence(0, int((size(lengths) - 1) / 256)), b -> aggregate(slice(lengths, 256 * b + 1, 256), 0, (t, x) -> t + x))", start="0")
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    row = f"named_struct('start', before[i] + char_length(pieces[i]), 'end', before[i] + char_length(pieces[i]) + char_length(hits[i]), 'value', hits[i], 'left', right(pieces[i], {CONTEXT}), 'right', left(pieces[i + 1], {CONTEXT}))"
    rows = f"transform(sequence(0, size(hits) - 1), i -> {row})"
    rows = let("before", f"flatten(transform(sequence(0, size({outer}) - 1), b -> {let('starts', outer, inner)}))", rows)
    rows = let("lengths", "transform(hits, (h, i) -> char_length(pieces[i]) + char_length(h))", rows)
    rows = let("pieces", pieces, rows)
    kind = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
    rows = let("hits", values, f"CASE WHEN size(hits) = 0 THEN cast(array() AS {kind}) ELSE {rows} END")
    return f"CASE WHEN NOT {text} rlike r'{needs}' THEN cast(array() AS {kind}) ELSE {rows} END"


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn check."""
    double = "CASE WHEN i % 2 = 0 THEN int(c) WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END"
    return f"aggregate(transform(filter(split(reverse({digits}), ''), c -> c != ''), (c, i) -> {double}), 0, (s, d) -> s + d) % 10 = 0"


def valid(kind: str, value: str) -> str:
    """SQL: the check that a base match of the kind must pass."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    if kind == "ip":
        return f"forall(split({value}, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(right(concat('000', p), 3)) <= 255)"
    if kind == "card":
        return f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn(digits)} ELSE false END"
    return f"length({digits}) BETWEEN 9 AND 15" if kind == "phone" else "true"


def features(c: str) -> str:
    """SQL: what the trees see of a candidate `c` (value, left, right)."""
    v = f"{c}.value"
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    flag = lambda x: f"CASE WHEN {x} THEN 1D ELSE 0D END"
    count = lambda x: f"cast(size(regexp_extract_all({v}, r'{x}', 0)) AS double)"
    near = [flag(f"concat({c}.left, ' ', {c}.right) rlike r'{w}'") for w in WORDS]
    return "array(" + ", ".join([
        f"cast(length({digits}) AS double)", flag(f"length({digits}) BETWEEN 12 AND 19 AND {luhn(digits)}"), count(r"[\x20./-]"), flag(f"{v} like '(%'"), count("[0-9]+"),
        flag(rf"{v} rlike r'^[0-9]+$'"), flag(rf"{v} rlike r'^(?:\(?0|\([0-9]{{3}}\)|[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}$)'"), *near,
        flag(rf"{v} rlike r'[(\[{{]'"), flag(rf"{v} rlike r'(?i)(?:dot|\.)\W*(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co|us|example|test)$'"),
        flag(rf"{v} rlike r'(?i)dot'"), count("[A-Za-z]+"), flag(rf"forall(split({v}, r'[^0-9]+'), p -> coalesce(try_cast(p AS int), 0) <= 255)"),
        flag(rf"{c}.left rlike r'[0-9A-Za-z][./-]?$'"), flag(rf"{c}.right rlike r'^[./-]?[0-9A-Za-z%$]'"), flag(rf"{v} rlike r'[0-9]{{4}}[ .-][0-9]{{4}}[ .-][0-9]{{4}}'"),
    ]) + ")"


def examples(n: int = 240, seed: int = 11) -> list[dict]:
    """Sentences with one candidate each: kind, text, label 1 (personal) or 0 (not)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "re", "on", "li", "er", "mo", "san", "vi", "ke", "du"]) for _ in range(rng.randint(1, 4)))
    some = lambda k: " ".join(word() for _ in range(rng.randint(1, k)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(right: bool) -> str:
        body = rng.choice("3456") + number(14)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, body)))
        last = -total % 10
        d = body + str(last if right else (last + rng.randint(1, 9)) % 10)
        return rng.choice([d, d, " ".join(d[i : i + 4] for i in (0, 4, 8, 12)), ".".join(d[i : i + 4] for i in (0, 4, 8, 12))])

    def phone() -> str:
        a, b, c = str(rng.randint(2, 9)) + number(2), number(3), number(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{number(2)} {number(4)} {number(4)}", f"0044 {number(2)} {number(4)} {number(4)}", f"{a} {b} {c}"])

    out = []
    for _ in range(n):
        user, host, top = word() + rng.choice(["", ".", "_"]) + word(), word() + rng.choice(["", number(1)]), rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
        at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" at ", " dot "), (" @ ", "."), ("@ ", " . "), ("(at)", ".")])
        lead = rng.choice(["", "", "mail ", "contact ", "write to "])
        out.append(("email", 1, f"{some(4)} {lead}{user}{at}{host}{dot}{top} {some(4)}"))
        out.append(("email", 0, f"{some(4)} {word()} {rng.choice(['at', 'at', '(at)'])} {word()}.{rng.choice([' ', ''])}{word().title()} {some(4)}"))
        octets = [str(rng.randint(0, 255)) for _ in range(4)]
        mark = rng.choice(["[.]", "(.)", " [.] ", "[dot]"])
        out.append(("ip", 1, f"{some(4)} {rng.choice(['', 'ip ', 'host ', 'from '])}{mark.join(octets)} {some(4)}"))
        out.append(("ip", 0, f"{some(4)} {mark.join(str(rng.randint(150, 999)) for _ in range(3))}{mark}{rng.randint(256, 999)} {some(4)}"))
        out.append(("card", 1, f"{some(3)} {rng.choice(['', 'card ', '', 'visa ', number(2) + ' '])}{card(True)}{rng.choice(['', ' ' + number(2)])} {some(3)}"))
        out.append(("card", 0, f"{some(3)} {rng.choice(['order ', '', 'id ', 'serial ', '', ''])}{card(False)} {some(3)}"))
        out.append(("phone", 1, f"{some(3)} {rng.choice(['call ', 'tel ', '', 'phone ', '', 'mobile '])}{phone()} {some(3)}"))
        plain = rng.choice([f"{number(3)}-{number(2)}-{number(2)}", f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.20{number(2)}", f"{number(4)} {number(3)} {number(2)}", f"{number(3)} {number(2)}", f"{number(2)}/{number(3)}/{number(4)}", f"{number(5)} {number(5)} {number(4)} {number(3)}"])
        out.append(("phone", 0, f"{some(3)} {rng.choice(['order ', '', 'version ', 'isbn ', 'ref ', ''])}{plain} {some(3)}"))
    return [{"kind": k, "label": y, "text": t} for k, y, t in out]


_FITTED: dict[str, dict[str, tuple[str, float]]] = {}


def models(spark: SparkSession) -> dict[str, tuple[str, float]]:
    """For each kind the SQL of a candidate's probability, and the threshold; fitted once for each application."""
    if spark.sparkContext.applicationId in _FITTED:
        return _FITTED[spark.sparkContext.applicationId]
    made = json.dumps(examples())
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(made), "array<struct<kind:string,label:int,text:string>>")).alias("e")).select("e.*")
    out = {}
    for kind in KINDS:
        every = "concat(" + ", ".join(found("text", p, n) for k, n, p in GENERATORS if k == kind) + ")"
        seen = rows.where(F.col("kind") == kind).select("label", "text", F.explode(F.expr(every)).alias("c")).select("label", "text", F.col("c.value").alias("value"), F.expr(features("c")).alias("f"))
        seen = sorted(seen.collect(), key=lambda r: (r.text, r.value))
        model = Boosted([list(r.f) for r in seen], [r.label for r in seen])
        out[kind] = (model.sql("f"), model.threshold(PRECISION))
    _FITTED[spark.sparkContext.applicationId] = out
    return out


def find_personal(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Personal data of every whole text; returns `keep`, base and spans.

    base and spans are arrays of (start, rank, end), ordered: code points, end exclusive, rank the place
    of the kind in KINDS.  base holds the leftmost non-overlapping matches of each kind's pattern that
    pass its check; spans holds base and the accepted candidates, none of which overlaps another span.
    A null text counts as empty, which has no spans; repeated rows each give a row, an empty table an empty
    result.  A kept column named base or spans gets _kept behind it.
    """
    fitted = models(docs.sparkSession)
    kept = Kept(keep, ("base", "spans"))
    rows = docs.select(F.coalesce(named(text_col), F.lit("")).alias("text"), *kept.inside())
    span = "named_struct('start', m.start, 'rank', {rank}, 'end', m.end)"
    base = [f"transform(filter({found('text', BASE[k], NEEDS[k])}, m -> {valid(k, 'm.value')}), m -> {span.format(rank=i)})" for i, k in enumerate(KINDS)]
    rated = []
    for kind, needs, pattern in GENERATORS:
        rank = KINDS.index(kind)
        free = "NOT exists(base, b -> b.start < c.end AND c.start < b.end)"
        chance, least = fitted[kind]
        score = f"element_at(transform(array({features('c')}), f -> {chance}), 1)"
        one = f"transform(filter({found('text', pattern, needs)}, c -> {free}), c -> named_struct('loss', -({score}), 'start', c.start, 'rank', {rank}, 'end', c.end))"
        rated.append(f"filter({one}, r -> r.loss <= -{least:.9e}D)")
    rows = rows.withColumn("base", F.expr(f"array_sort(concat({', '.join(base)}))"))
    rows = rows.withColumn("rated", F.expr(f"array_sort(concat({', '.join(rated)}))"))
    kind = "array<struct<start:int,rank:int,end:int>>"
    taken = f"aggregate(rated, cast(array() AS {kind}), (a, r) -> CASE WHEN exists(a, x -> x.start < r.end AND r.start < x.end) THEN a ELSE array_append(a, named_struct('start', r.start, 'rank', r.rank, 'end', r.end)) END)"
    rows = rows.withColumn("spans", F.expr(f"array_sort(concat(base, {taken}))"))
    return rows.select(*kept.outside(), "base", "spans")


def spans_text(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}[s.rank], ':', s.start, ':', s.end)), ',')")


def redact(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the text with each span replaced by its kind in brackets; overlapping base spans merge into the first."""
    both = docs.select(*[F.col(c).alias(c) for c in dict.fromkeys([*keep, text_col])])
    rows = find_personal(both, text_col, (*keep, *([text_col] if text_col not in keep else [])))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    step = f"CASE WHEN s.end <= a.at THEN a WHEN s.start < a.at THEN named_struct('out', a.out, 'at', s.end) ELSE named_struct('out', concat(a.out, substring(source, a.at + 1, s.start - a.at), '[', {names}[s.rank], ']'), 'at', s.end) END"
    rows = rows.withColumn("source", F.coalesce(F.col(text_col), F.lit("")))
    done = F.expr(f"aggregate(spans, named_struct('out', '', 'at', 0), (a, s) -> {step}, a -> concat(a.out, substring(source, a.at + 1)))")
    return rows.withColumn("redacted_text", done).select(*[c for c in keep if c != text_col], F.col("redacted_text").alias(text_col))
