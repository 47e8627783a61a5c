"""Personal data by weak supervision, in DataFrame functions only.

Candidates are spans of wide patterns for e-mail addresses, IP addresses, card and phone numbers, with
their places in code points. Labelers vote yes, no or abstain on each: the strict form, a check (Luhn,
octets, digits), a gazetteer (top-level domains, issuer and country prefixes, reserved networks), context words before
it (up to 30 characters, back to where the pattern's last match began) and its edges. Expectation-maximisation over the counts of vote patterns (at most ``4 * 3**5`` rows,
whatever the corpus) estimates how reliable each labeler is; its posteriors train a logistic span classifier
over votes and length, which becomes one column expression. Base spans, those of the strict form that pass
its check, always stay; the classifier adds others that pass their check and overlap no base span.

Defined cases: a null or empty text has no spans; adjacent and repeated matches count each; of
overlapping spans of several kinds all are reported and redaction replaces their union by the first kind;
repeated rows are judged each; very long texts are read whole, in time that grows with the text and with their spans to the power 1.5;
an empty table gives an empty result, and with no candidates there is
nothing to train, so nothing is added; further columns of ``docs`` stay, those named ``v_*`` are replaced. Patterns are possessive
and start at run starts, so that long runs of letters or digits neither overflow the stack nor cost squares.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlens.llm.common import documents, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "check", "gazetteer", "context", "edge")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Strict forms; \G lets a match begin where the last one ended inside a run.
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Other ways to write the same.
WIDER = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\.)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?!)",
    "phone": r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z.-])",
}
#: What a text must have before a pattern is tried on it.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDER_HINTS = {"email": r"(?i)[\(\[{]at[\)\]}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"(?!)", "phone": r"[0-9]{3}[.-][0-9]{4}"}
DOMAINS = "com|net|org|edu|gov|io|co|info|biz|dev|app|de|fr|es|uk|us|eu|it|nl|ch|at|be|ca|au|jp|cn|br|in|mx"
COUNTRIES = "1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|kontakt|courriel|correo)[^A-Za-z]{0,4}(?:[a-z]+[^A-Za-z]{1,3})?$",
    "ip": r"(?i)(?:\bip\b|address|host|server|adresse|login|from)[^A-Za-z]{0,4}(?:[a-z]+[^A-Za-z]{1,3})?$",
    "card": r"(?i)(?:card|visa|mastercard|credit|karte|carte|tarjeta|number|no\.?)[^A-Za-z]{0,4}(?:[a-z]+[^A-Za-z]{1,3})?$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|telefon|tél|llam\w*)[^A-Za-z]{0,4}(?:[a-z]+[^A-Za-z]{1,3})?$",
}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once, also where ``body`` names it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, op, kind: str = "int") -> Column:
    """The array's running results under ``op`` from 0, by blocks of the square root of its size."""

    def of(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(v), step), lambda a: F.slice(v, a, step))
        inside = lambda b, before: F.transform(b, lambda _, j: F.aggregate(F.slice(b, F.lit(1), j + 1), before, op))
        whole = lambda bs, sums: F.transform(bs, lambda b, i: _let(F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0), op), lambda before: inside(b, before)))
        some = _let(blocks, lambda bs: _let(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), op)), lambda sums: F.flatten(whole(bs, sums))))
        return F.when(F.size(v) > 0, some).otherwise(F.array().cast(f"array<{kind}>"))

    return _let(values, of)


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


_CANDIDATE = "array<struct<start:int,strict:boolean,kind:string,match:string,before:string,after:string>>"


def _matches(text: Column, pattern: str, hint: str, kind: str, strict: bool) -> Column:
    """array of ``_CANDIDATE`` of all matches, in order."""
    blank = F.lit("")

    def rows(p: Column, m: Column, ends: Column) -> Column:
        before = lambda i: F.right(F.concat(F.coalesce(F.get(m, i - 1), blank), F.get(p, i)), F.lit(30))
        after = lambda i: F.left(F.concat(F.get(p, i + 1), F.coalesce(F.get(m, i + 1), blank)), F.lit(1))
        return F.transform(m, lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("start"), F.lit(strict).alias("strict"), F.lit(kind).alias("kind"), x.alias("match"), before(i).alias("before"), after(i).alias("after")))

    sizes = lambda p, m: F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x))
    found = _let(F.split(text, pattern, -1), lambda p: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _let(_running(sizes(p, m), lambda x, y: x + y), lambda ends: rows(p, m, ends))))
    return F.when(text.rlike(hint), found.cast(_CANDIDATE)).otherwise(F.array().cast(_CANDIDATE))


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _votes(c: Column) -> dict[str, Column]:
    """Labelers' votes on a candidate: 1, -1, or 0 to abstain."""
    m, kind = c["match"], c["kind"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    before = c["before"]
    edges = F.concat(F.right(before, F.lit(1)), c["after"])

    def by_kind(**of: Column) -> Column:
        out = F.lit(0)
        for k, v in of.items():
            out = F.when(kind == k, v).otherwise(out)
        return out

    yes = lambda p, no=-1: F.when(p, 1).otherwise(no)
    return {
        "form": yes(c["strict"], 0),
        "check": by_kind(
            email=yes(m.rlike(r"(?i)[.\)\]} ][a-z]{2,10}$")),
            ip=yes(m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") | m.contains(":")),
            card=F.when(n.between(13, 19), yes(_luhn(digits))).otherwise(-1),
            phone=yes(n.between(9, 15)),
        ),
        "gazetteer": by_kind(
            email=yes(m.rlike(rf"(?i)[.\)\]}} ](?:{DOMAINS})$"), 0),
            ip=yes(~m.rlike(r"^(?:0|22[4-9]|2[3-9][0-9])\.")),
            card=yes(digits.rlike("^[3-6]"), 0),
            phone=yes(m.rlike(rf"^\+(?:{COUNTRIES})") | m.rlike(r"^\(?[2-9]"), 0),
        ),
        "context": by_kind(**{k: yes(before.rlike(p), 0) for k, p in CONTEXT.items()}),
        "edge": yes(~edges.rlike("[A-Za-z0-9]")),
    }


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``v_found``: kind, start, end, base and the votes of each candidate, by kind and start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs
    for k in KINDS:
        of = _matches(text, FORMS[k], HINTS[k], k, True)
        d = d.withColumn(f"v_{k}", F.sort_array(F.concat(of, _matches(text, WIDER[k], WIDER_HINTS[k], k, False))) if k != "card" else of)
    # numbers too short or too long to be cards are no candidates
    d = d.withColumn("v_card", F.filter("v_card", lambda c: F.length(F.regexp_replace(c["match"], "[^0-9]", "")).between(13, 19)))

    def voted(c: Column) -> Column:
        v = _votes(c)
        base = c["strict"] & ((v["check"] == 1) | (c["kind"] == "email"))
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (c["start"] + F.length(c["match"])).alias("end"), base.alias("base"), *[v[k].cast("int").alias(k) for k in LABELERS])

    d = d.withColumn("v_found", F.transform(F.concat(*[f"v_{k}" for k in KINDS]), voted))
    return d.drop(*[f"v_{k}" for k in KINDS])


def reliabilities(patterns: dict[tuple, int], rounds: int = 25) -> dict[tuple, float]:
    """EM over (kind, length class, votes...) counts: each pattern's probability of being personal data. Votes are independent given the truth and the kind."""
    posterior = {p: 1 / (1 + math.exp(-sum(p[2:]))) for p in patterns}
    for _ in range(rounds):
        truth: dict[str, list[float]] = {}
        seen: dict[tuple, list[float]] = {}
        for p, n in patterns.items():
            weights = (n * (1 - posterior[p]), n * posterior[p])
            for y, w in enumerate(weights):
                truth.setdefault(p[0], [1.0, 1.0])[y] += w
                for k, v in enumerate(p[2:]):
                    seen.setdefault((p[0], k, v), [0.5, 0.5])[y] += w
        for p in patterns:
            odds = math.log(truth[p[0]][1] / truth[p[0]][0])
            for k, v in enumerate(p[2:]):
                a = seen[(p[0], k, v)]
                odds += math.log(a[1] / truth[p[0]][1]) - math.log(a[0] / truth[p[0]][0])
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior


def trained(patterns: dict[tuple, int], posterior: dict[tuple, float], rounds: int = 300) -> dict[tuple, float]:
    """Weights of a logistic classifier over features (what, value), fitted to the posteriors."""
    weights: dict[tuple, float] = {}
    total = sum(patterns.values())
    for _ in range(rounds):
        gradient: dict[tuple, float] = {}
        for p, n in patterns.items():
            features = _features(p)
            g = n / total * (1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in features))) - posterior[p])
            for f in features:
                gradient[f] = gradient.get(f, 0.0) + g
        for f, g in gradient.items():
            weights[f] = weights.get(f, 0.0) * 0.9995 - 2.0 * g
    return weights


def _features(p: tuple) -> list[tuple]:
    return [("kind", p[0]), ("length", p[1]), *((name, v) for name, v in zip(LABELERS, p[2:], strict=True))]


def _length_class(c: Column) -> Column:
    return F.least(F.floor((c["end"] - c["start"]) / 8), F.lit(5)).cast("int")


def classified(found: DataFrame) -> DataFrame:
    """``found`` (with ``v_found``) with ``v_spans``: kind, start, end and base of all spans that stay."""
    c = F.col("c")
    rows = found.select(F.explode("v_found").alias("c")).groupBy(c["kind"].alias("kind"), _length_class(c).alias("length"), *[c[k].alias(k) for k in LABELERS]).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = {tuple(r)[:-1]: r["n"] for r in rows}
    weights = trained(patterns, reliabilities(patterns)) if patterns else {}

    def score(x: Column) -> Column:
        out = F.lit(0.0)
        values = {"kind": x["kind"], "length": _length_class(x), **{k: x[k] for k in LABELERS}}
        for name, column in values.items():
            of = F.lit(0.0)
            for (what, value), w in sorted(weights.items(), key=str):
                if what == name:
                    of = F.when(column == value, F.lit(w)).otherwise(of)
            out = out + of
        return out

    def kept(all_: Column, base: Column, ends: Column, heads: Column, step: Column) -> Column:
        """``base``: base spans by start; ``ends``: their running greatest end; ``heads``: every ``step``-th start."""

        def apart(x: Column) -> Column:
            block = F.size(F.filter(heads, lambda h: h < x["end"]))
            before = (block - 1) * step + F.size(F.filter(F.slice(base, F.greatest((block - 1) * step, F.lit(0)) + 1, step), lambda b: b["start"] < x["end"]))
            return F.when(block == 0, True).otherwise(F.get(ends, before - 1) <= x["start"])

        return F.filter(all_, lambda x: x["base"] | ((score(x) > 0) & (x["check"] == 1) & apart(x)))

    def chosen(all_: Column) -> Column:
        spans = F.sort_array(F.transform(F.filter(all_, lambda x: x["base"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        step = lambda base: F.greatest(F.ceil(F.sqrt(F.size(base))).cast("int"), F.lit(1))
        heads = lambda base: F.filter(F.transform(base, lambda b, i: F.when(i % step(base) == 0, b["start"])), lambda h: h.isNotNull())
        ends = lambda base: _running(F.transform(base, lambda b: b["end"]), _larger)
        return _let(spans, lambda base: _let(ends(base), lambda e: _let(heads(base), lambda h: _let(step(base), lambda n: kept(all_, base, e, h, n)))))

    spans = F.filter("v_found", lambda x: x["base"])
    if weights:  # most texts have base spans only
        spans = F.when(F.exists("v_found", lambda x: ~x["base"]), chosen(F.col("v_found"))).otherwise(F.col("v_found"))
    return found.withColumn("v_spans", F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))))


def found(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text unless kept) with ``v_found`` and ``v_spans``."""
    docs = docs.drop("v_found", "v_spans", *[f"v_{k}" for k in KINDS])
    d = candidates(docs, text_col)
    return classified(written(d if keep_text else d.drop(text_col), "candidates"))


#: Characters of a piece of text; places are found in pieces and not from the text's start.
PIECE = 1024


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets."""
    text, one = F.col(text_col), F.lit(1)

    def part(pieces: Column, a: Column, b: Column) -> Column:
        """The characters from place a to b."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        long = F.concat(F.substring(F.get(pieces, first), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(pieces, last), F.lit("")), one, b % PIECE))
        return F.when(first == last, F.substring(F.coalesce(F.get(pieces, first), F.lit("")), a % PIECE + 1, b - a)).otherwise(long)

    def joined(pieces: Column, spans: Column, ends: Column, heads: Column) -> Column:
        """``ends``: the spans' running greatest end; ``heads``: places of the spans that overlap none before them."""
        until = lambda k: F.coalesce(F.get(ends, F.get(heads, k) - 1), F.lit(0))
        at = lambda k: F.get(spans, F.get(heads, k))
        shown = F.transform(heads, lambda _, k: F.concat(part(pieces, until(k), at(k)["start"]), F.lit("["), F.upper(at(k)["kind"]), F.lit("]")))
        return F.concat(F.array_join(shown, ""), part(pieces, F.element_at(ends, -1), F.length(text)))

    spans = F.sort_array(F.transform("v_spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    ends = lambda s: _running(F.transform(s, lambda x: -x["back"]), _larger)
    heads = lambda s, e: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(e, i - 1)), i)), lambda i: i.isNotNull())
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    done = _let(pieces, lambda p: _let(spans, lambda s: _let(ends(s), lambda e: _let(heads(s, e), lambda h: joined(p, s, e, h)))))
    d = found(docs, text_col, keep_text=True)
    return d.withColumn(text_col, F.when(F.size("v_spans") > 0, done).otherwise(text)).select(*docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the personal data of every document, counted and digested."""
    d = found(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("v_spans", lambda s: s["base"])
    n = lambda kind: F.size(F.filter("v_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *map(n, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("v_spans")).alias("spans"))
