"""Personal data: labelers vote on candidate spans, EM weighs them, and a classifier decides; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import bound
from textloom.session import materialise

#: The kinds, in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
#: Characters put in place of a dot or separator between the characters that it may join, so that patterns need no
#: nested repetition, which Java's matcher runs by recursion. Texts that hold one already have it replaced by a control character first.
DOT, GAP = "", ""
#: Fixed values. Base patterns, on texts with the marks above; a match starts where the plain pattern's leftmost match does.
EMAIL = rf"(?:(?<![A-Za-z0-9._%+{DOT}-])|\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{GAP}])[0-9](?:{GAP}?[0-9]){{11,18}}(?![0-9{GAP}])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An IP part of at most 255.
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Looser candidates: mail addresses and hosts written out, card numbers with other separators, and phone numbers without a country code.
LOOSE_EMAIL = r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}){1,8}"
LOOSE_IP = r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?\[dot\] ?)[0-9]{1,3}){3}(?![0-9.])"
LOOSE_CARD = r"(?<![0-9./_-])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_-])"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.)(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"
#: Gazetteers: what is known at the beginning or end of such data.
KNOWN = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|127\.|169\.254\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+?(?:1[ (.-]|[2-9][0-9]|\()",
}
#: Words that stand before such data, within CONTEXT characters.
NEAR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|address|server|login|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|contact|telefon|téléphone|teléfono)\b",
}
CONTEXT = 30
_NONE = "array<struct<s:int,e:int,m:string,near:string>>"
#: Values that are added up in one go, see before_each(); and characters in the pieces of a text that are cut apart.
BLOCK, PIECE = 256, 4096


def before_each(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What an array's earlier values combine to, for each of its values: sums or maxima from 0 on.

    Blocks of BLOCK values are run through apart and moved by what the blocks before them come to, so the arrays that grow
    step by step stay short, and the work grows about in proportion to the number of values.
    """
    empty = F.array().cast("array<long>")
    state = lambda t, out: F.struct(t.alias("t"), out.alias("out"))
    run = lambda xs: F.aggregate(xs, state(F.lit(0).cast("long"), empty), lambda acc, x: state(combine(acc["t"], x), F.concat(acc["out"], F.array(acc["t"]))))

    def blocked(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return bound(F.transform(starts, lambda k: run(F.slice(v, k * BLOCK + 1, BLOCK))), merged)

    def merged(blocks: Column) -> Column:
        totals = run(F.transform(blocks, lambda x: x["t"]))["out"]
        return F.flatten(F.zip_with(blocks, totals, lambda x, moved: F.transform(x["out"], lambda y: combine(moved, y))))

    return bound(values.cast("array<long>"), lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(empty))


def spans(text: Column, pattern: str) -> Column:
    """All matches as array<struct<s,e,m,near>>: start, end (exclusive, in code points), the match, and the CONTEXT characters
    between the match before and this one that are next to it.

    What lies between the matches tells their places. pattern never matches the empty string.
    """

    def placed(parts: Column) -> Column:
        before = before_each(F.transform(parts, lambda x: x["skip"] + F.coalesce(F.length(x["m"]), F.lit(0))), lambda a, b: a + b)

        def place(x: Column, at: Column) -> Column:
            s = (at + x["skip"]).cast("int")
            return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), x["near"].alias("near"))

        return F.filter(F.zip_with(parts, before, place), lambda x: x["m"].isNotNull())

    part = lambda a, m: F.struct(F.length(a).alias("skip"), F.right(a, F.lit(CONTEXT)).alias("near"), m.alias("m"))
    return bound(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), part), placed)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _where(cheap: Column, found: Column) -> Column:
    """found where the cheap test holds, else nothing: most texts never meet the costly pattern."""
    return F.when(cheap, found).otherwise(F.array().cast(_NONE))


def base_spans(text: Column) -> dict[str, Column]:
    """The base matches of each kind, failing ones dropped."""
    dotted = F.regexp_replace(F.translate(text, DOT, "\x01"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    joined = F.regexp_replace(F.translate(text, GAP, "\x01"), r"(?<=[0-9])[\x20-](?=[0-9])", GAP)
    count = lambda m: F.length(digits(m))
    email = F.transform(spans(dotted, EMAIL), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.translate(x["m"], DOT, ".").alias("m"), F.translate(x["near"], DOT, ".").alias("near")))
    return {
        "email": _where(F.contains(text, F.lit("@")), email),
        "ip": _where(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(spans(text, IP), lambda x: x["m"].rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"))),
        "card": _where(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.filter(spans(joined, CARD), lambda x: luhn(digits(x["m"])))),
        "phone": _where(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE), lambda x: count(x["m"]).between(9, 15))),
    }


def loose_spans(text: Column) -> dict[str, Column]:
    """Further candidates, by kind."""
    return {
        "email": _where(text.rlike(r"[\[(](?:at|AT)[\])]"), spans(text, LOOSE_EMAIL)),
        "ip": _where(text.rlike(r"[0-9] ?[\[(](?:\.|dot)[\])] ?[0-9]"), spans(text, LOOSE_IP)),
        "card": _where(text.rlike(r"[0-9]{4}[./_][0-9]{4}"), F.filter(spans(text, LOOSE_CARD), lambda x: luhn(digits(x["m"])))),
        "phone": _where(text.rlike(r"[0-9]{3}[ .-][0-9]{4}"), spans(text, LOOSE_PHONE)),
    }


@dataclass(frozen=True)
class Reliability:
    """What EM has learnt: the share of true candidates, and for each labeler how often it votes for true and false ones."""

    prior: float
    true: tuple[float, ...]
    false: tuple[float, ...]

    def posterior(self, votes: tuple[bool, ...]) -> float:
        """Probability that a candidate with these votes is personal data."""
        odds = math.log(self.prior / (1 - self.prior))
        for v, p, q in zip(votes, self.true, self.false):
            odds += math.log(p / q) if v else math.log((1 - p) / (1 - q))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def learn_reliability(patterns: dict[tuple[bool, ...], int], rounds: int = 50) -> Reliability:
    """EM over counts of vote patterns: voters are independent given the truth. Estimates keep off 0 and 1."""
    n = len(next(iter(patterns), ()))
    found = Reliability(0.7, (0.8,) * n, (0.3,) * n)
    for _ in range(rounds):
        weight = {v: found.posterior(v) for v in patterns}
        yes = sum(c * weight[v] for v, c in patterns.items())
        no = sum(c * (1 - weight[v]) for v, c in patterns.items())
        rate = lambda k, w, total: (sum(c * w(v) for v, c in patterns.items() if v[k]) + 1) / (total + 2)
        true = tuple(rate(k, lambda v: weight[v], yes) for k in range(n))
        false = tuple(rate(k, lambda v: 1 - weight[v], no) for k in range(n))
        found = Reliability(min(0.99, max(0.01, (yes + 1) / (yes + no + 2))), true, false)
    return found


#: What the classifier sees of a span, none of which a labeler looks at, each 0, 1 or 2: how many groups of digits or
#: labels it has, how many kinds of separators, how the text goes on before it, and what its last group is like.
FEATURES = ("groups", "marks", "edge", "tail")


def _levels(n: Column, one: int, two: int) -> Column:
    return F.when(n >= two, 2).when(n >= one, 1).otherwise(0)


def _features(x: Column, kind: str) -> dict[str, Column]:
    parts = F.filter(F.split(x["m"], "[^A-Za-z0-9]+"), lambda p: p != "")
    marks = sum((F.contains(x["m"], F.lit(c)).cast("int") for c in " .-()[]"), F.lit(0))
    last = F.length(F.element_at(parts, -1))
    edge = F.when(x["near"].rlike(r"[:=]\s*$"), 2).when(x["near"].rlike(r"(?:^|\s)$"), 1).otherwise(0)
    tail = _levels(F.coalesce(last, F.lit(0)), 3, 5) if kind == "email" else _levels(F.coalesce(last, F.lit(0)), 2, 4)
    return {"groups": _levels(F.size(parts), 3, 5), "marks": _levels(marks, 1, 2), "edge": edge, "tail": tail}


def learn_classifier(examples: list[tuple[tuple[int, ...], float, float]], steps: int = 800) -> list[float]:
    """Logistic regression from features to EM's probabilities. examples: (features, probability, count); a bias, then two weights a feature."""
    total = sum(c for _, _, c in examples)
    n = len(examples[0][0])
    w = [0.0] * (2 * n + 1)
    active = [([0] + [2 * k + v for k, v in enumerate(f) if v], p, c / total) for f, p, c in examples]
    for _ in range(steps):
        g = [1e-3 * x for x in w]
        for at, target, share in active:
            e = (1 / (1 + math.exp(-sum(w[i] for i in at))) - target) * share
            for i in at:
                g[i] += e
        w = [x - 1.0 * y for x, y in zip(w, g)]
    return w


def _voter(kind: str, is_base: bool):
    """A candidate span to its place, the votes of the labelers, and features."""

    def votes(x: Column) -> Column:
        return F.struct(
            x["s"].alias("s"),
            F.lit(KINDS.index(kind)).alias("k"),
            x["e"].alias("e"),
            F.lit(is_base).alias("regex"),
            x["m"].rlike(KNOWN[kind]).alias("gazetteer"),
            x["near"].rlike(NEAR[kind]).alias("context"),
            (F.length(x["m"]).between(6, 64) if kind == "email" else F.length(digits(x["m"])) >= 7).alias("shape"),
            *[c.cast("int").alias(name) for name, c in _features(x, kind).items()],
        )

    return votes


def _found(text: Column) -> Column:
    """All candidates of a text with their votes, in order."""
    parts = [F.transform(found, _voter(kind, is_base)) for is_base, group in ((True, base_spans(text)), (False, loose_spans(text))) for kind, found in group.items()]
    return F.array_sort(F.concat(*parts))


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id and found, its candidates in order."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return slim.select("doc_id", _found(F.col("text")).alias("found"))


LABELERS = ("regex", "gazetteer", "context", "shape")


def _listing(found: Column) -> Column:
    """kind:start:end of each span, in their order, joined by commas."""
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", kind(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


Classifiers = dict[int, list[float]]
#: A place behind every text.
FAR = 1 << 40


def learn(candidates: DataFrame) -> Classifiers:
    """For each kind a classifier trained on EM's probabilities.

    Only counts of votes with features, at most 2**4 * 3**4 a kind, go to the driver.
    """
    exploded = candidates.select(F.explode("found").alias("x")).select("x.k", *[f"x.{v}" for v in (*LABELERS, *FEATURES)])
    counted: dict[int, list[tuple[tuple[bool, ...], tuple[int, ...], int]]] = {}
    for row in exploded.groupBy("k", *LABELERS, *FEATURES).count().collect():
        counted.setdefault(row[0], []).append((tuple(row[1 : 1 + len(LABELERS)]), tuple(row[1 + len(LABELERS) : -1]), row[-1]))
    out = {}
    for k, rows in counted.items():
        patterns: dict[tuple[bool, ...], int] = {}
        for votes, _, n in sorted(rows):
            patterns[votes] = patterns.get(votes, 0) + n
        reliability = learn_reliability(patterns)
        out[k] = learn_classifier([(seen, reliability.posterior(votes), n) for votes, seen, n in sorted(rows)])
    return out


def chosen_spans(found: Column, classifiers: Classifiers, threshold: float) -> Column:
    """The base spans, and of the others those that the classifier takes and that overlap no base span."""

    def probability(x: Column) -> Column:
        out = F.lit(0.0)
        for k, w in sorted(classifiers.items()):
            weigh = lambda name, i, w=w: F.when(x[name] == 1, F.lit(w[2 * i + 1])).when(x[name] == 2, F.lit(w[2 * i + 2])).otherwise(0.0)
            logit = sum((weigh(name, i) for i, name in enumerate(FEATURES)), F.lit(w[0]))
            out = F.when(x["k"] == k, 1 / (1 + F.exp(-logit))).otherwise(out)
        return out

    def free(spans: Column) -> Column:
        # Spans are in order of their starts. One meets a base span if one before it ends behind its start, or if one after
        # it starts before its end: the latter is seen from the other side, in the order of ends, by negated places.
        left = before_each(F.transform(spans, lambda b: F.when(b["regex"], b["e"]).otherwise(0)), F.greatest)
        right = F.reverse(before_each(F.transform(F.reverse(spans), lambda b: F.when(b["regex"], FAR - b["s"]).otherwise(0)), F.greatest))
        edges = F.zip_with(left, right, lambda a, b: F.struct(a.alias("until"), (FAR - b).alias("from")))
        marked = F.zip_with(spans, edges, lambda x, y: F.when(x["regex"] | ((probability(x) >= threshold) & (y["until"] <= x["s"]) & (y["from"] >= x["e"])), x))
        return F.filter(marked, lambda x: x.isNotNull())

    return F.when(F.exists(found, lambda x: ~x["regex"]), bound(found, free)).otherwise(found)


def detect(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, and found (all spans as structs).

    Base spans are the matches of the base patterns and always stay. The labelers (base pattern, gazetteer, context
    words, shape) vote on them and on looser candidates; EM over the counts of vote patterns estimates how reliable each
    is, a logistic classifier of features that no labeler looks at is trained on its probabilities, and candidates that
    overlap no base span are added from `threshold` on. A null text is empty; every row gives a row, also where ids repeat; an empty table gives
    an empty result.

    One pass over the texts writes the candidates, which the rest reads. Nothing is shuffled but counts of vote patterns.
    """
    candidates = materialise(_candidates(docs, id_col, text_col), "candidates")
    base = F.filter("found", lambda x: x["regex"])
    chosen = chosen_spans(F.col("found"), learn(candidates), threshold)
    of_kind = lambda k: F.size(F.filter(base, lambda x: x["k"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return candidates.select("doc_id", *counts, F.sha2(_listing(base).cast("binary"), 256).alias("base_sha256"), _listing(chosen).alias("spans"), chosen.alias("found"))


def redacted(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets, and n_chars, where there is such a column, counted anew.

    One pass over the texts finds the candidates and writes them beside the rows; the other learns from them and replaces.
    Rows stay where they are and nothing is joined. A null text stays null, repeated rows stay repeated, and an empty
    table stays empty. Columns of docs may have any names.
    """
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), _found(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("found"))
    rows = materialise(whole, "candidates")
    old = F.col(f"doc.`{text_col}`")
    new = F.when(F.size("found") > 0, _replaced(old, chosen_spans(F.col("found"), learn(rows), threshold)))
    rows = rows.select("doc", new.alias("new"))
    changed = {text_col: F.coalesce("new", old)}
    if "n_chars" in columns:
        changed["n_chars"] = F.coalesce(F.length("new").cast(docs.schema["n_chars"].dataType), F.col("doc.n_chars"))
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])


def _replaced(text: Column, chosen: Column) -> Column:
    """text with each span's kind in its place. The text is cut into pieces, so that no place is sought from its beginning."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def between(pieces: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / PIECE), F.floor(b / PIECE)
        return F.substring(F.array_join(F.slice(pieces, (i + 1).cast("int"), (j - i + 1).cast("int")), ""), (a - i * PIECE + 1).cast("int"), (b - a).cast("int"))

    def cut(both: Column) -> Column:
        pieces, spans = both["pieces"], both["spans"]
        until = before_each(F.transform(spans, lambda x: x["e"]), F.greatest)
        # Spans of different kinds may overlap; what an earlier one has covered is gone.
        part = lambda x, at: F.when(x["e"] <= at, "").otherwise(F.concat(between(pieces, at, F.greatest(x["s"], at)), F.element_at(names, x["k"] + 1)))
        end = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["e"]))
        return F.concat(F.array_join(F.zip_with(spans, until, part), ""), between(pieces, end, F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    return bound(F.struct(pieces.alias("pieces"), chosen.alias("spans")), cut)
