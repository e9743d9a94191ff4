"""Personal data: candidate spans from high-recall generators, scored by boosted trees, in DataFrame functions only.

Generators propose overlapping spans of five kinds. A strict expression per kind, with its check (octets, Luhn, number of
digits, a key word before a secret), gives the base spans of the first four kinds, which always stay, and secrets; looser
expressions give further candidates. Trees over format and context features (digits, separators, length, check, form,
neighbours, key words before the span; of a form without country codes and with the separators of obfuscated addresses made
plain) decide on secrets and on loose candidates.

The labels are planted: spans of known forms, and decoys that the generators propose too but that are no personal data, are
put between stretches of the corpus's own texts and go through the same generators. All rows of the corpus count as well:
base spans as positives, loose candidates, which nobody has labelled, as negatives by a small weight, both together by no
more weight than the plants. A quarter of the plants is held out from the trees; the threshold of a kind is the lowest score
down to which PRECISION of the held-out plants are personal data. The trees are fitted to contingency tables of the features.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.arrays import blocks_of, fold_append, let
from pagequarry.llm.base import as_row, cut, keep, row_columns
from pagequarry.llm.boosting import Boosted, fit

#: The kinds of the contract come first.
KINDS = ("email", "ip", "card", "phone", "secret")
#: The contract's expressions. Possessive, and tied to the start of a run of their first class (or to the end of the last
#: match), so that long runs cost no more than their length; they match the same spans.
STRICT = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
    r"(?<=[\"'= :])(?<=(?i:token|secret|passw.rd|api.?key|access.?key) {0,2}[=:] {0,2}[\"']{0,1})[A-Za-z0-9+/_-]{16,256}+",
)
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}",
    r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Fa-f:])",
    r"(?<![0-9])(?:[0-9]{4}(?:[._/][0-9]{4}){3}|[0-9]{13,19}+)(?![0-9])",
    r"(?<![0-9+.-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /.-]|[0-9]{3}[.-])[0-9]{2,4}(?:[ .-][0-9]{2,5}){1,3}(?![0-9])",
    r"(?<![A-Za-z0-9+/_-])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+|(?:AKIA|ghp_|sk-)[A-Za-z0-9_-]{16,64}+)(?![A-Za-z0-9+/_-])",
)
#: Text of which every match holds some; an expression is tried only where one of them is found.
GATES = (("@",), (".",), None, ("+",), ("=", ":"))
LOOSE_GATES = (("(dot)", "[dot]", " dot "), (":", "[.]"), tuple("0123456789"), None, ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9"))
CONTEXT = (r"(?i)mail|contact|write|reach", r"(?i)\bip\b|server|host|addr|node", r"(?i)card|visa|credit|carte|karte|tarjeta", r"(?i)tel|phone|call|fax|mobil|whatsapp|fon", r"(?i)token|secret|passw|key|auth|bearer")
FEATURES = ("kind", "valid", "digits", "seps", "size", "form", "near", "before", "after")
BEFORE = 32
#: Forms of a kind that say much by themselves, as expressions on plain values; form is the number of those that fit.
FORMS = (
    (r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at)$",),
    (":", "[A-Fa-f]"),
    ("^[0-9]{4}[^0-9]",),
    (r"^[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$",),
    ("^(?:AKIA|ghp_|sk-)", "^(?:.{16}|.{20}|.{32}|.{40}|.{64})$"),
)
#: Planted rows of each form; stretches of the corpus that they stand in, and their length; every FOLDS-th plant is held out.
PLANTS, CONTEXTS, STRETCH, FOLDS = 128, 256, 80, 4
#: Share of personal data among the held-out plants that a kind's threshold lets through.
PRECISION = 0.95
#: Weight, as negatives, of loose candidates that may be personal data for all that is known.
UNLABELLED = 0.1


def _located(text: Column, matches: Column, rx: str) -> Column:
    """Array of s, e (code points, end exclusive), v, pre, post for the matches of rx, from the pieces between them."""
    pieces = F.split(text, rx, -1)
    parts = F.zip_with(
        matches,
        F.slice(pieces, 1, F.size(matches)),
        lambda v, p: F.struct(v.alias("v"), F.length(p).cast("long").alias("gap"), F.length(v).cast("long").alias("len"), F.right(p, F.lit(BEFORE)).alias("pre")),
    )
    follow = F.transform(F.slice(pieces, 2, F.size(matches)), lambda p: F.left(p, F.lit(1)))
    parts = F.zip_with(parts, follow, lambda x, p: F.struct(x["v"].alias("v"), x["gap"].alias("gap"), x["len"].alias("len"), x["pre"].alias("pre"), p.alias("post")))
    kind = "struct<s:bigint,e:bigint,v:string,pre:string,post:string>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["gap"]
        one = F.struct(s.alias("s"), (s + x["len"]).alias("e"), x["v"].alias("v"), x["pre"].alias("pre"), x["post"].alias("post"))
        return s + x["len"], F.array(one)

    found = let(parts, lambda p: fold_append(p, F.lit(0).cast("long"), step, kind))
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(f"array<{kind}>"))


def _luhn_sum(digits: Column) -> Column:
    """The sum of a number of up to 19 digits given from its last to its first."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d < 5, 2 * d).otherwise(2 * d - 9)

    n = F.length(digits)
    return F.aggregate(F.when(n.between(1, 19), F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(1))), F.lit(0), add)


def _luhn(v: Column) -> Column:
    """13 to 19 digits with a right check digit."""
    return let(F.reverse(F.regexp_replace(v, "[^0-9]", "")), lambda digits: F.length(digits).between(13, 19) & (_luhn_sum(digits) % 10 == 0))


def _valid(kind: int, v: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        octets = F.split(F.regexp_replace(v, r"\[\.\]", "."), r"\.")

        def small(o: Column) -> Column:
            bare = F.ltrim(o, F.lit("0"))
            return (F.length(bare) <= 3) & (F.coalesce(F.concat(F.lit("0"), F.left(bare, F.lit(3))).try_cast("int"), F.lit(999)) <= 255)

        return F.contains(v, F.lit(":")) | F.forall(octets, small)
    if kind == 2:
        return _luhn(v)
    if kind == 3:
        return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)
    # Letters and digits mixed, or at least not one character again and again.
    return v.rlike("[0-9]") & v.rlike("[A-Za-z]")


def _bucket(c: Column, *cuts: int) -> Column:
    return reduce(lambda a, b: a + b, [(c >= x).cast("int") for x in cuts])


def _side(c: Column) -> Column:
    """0 at the end of the text or a blank, 1 letter or digit, 2 other."""
    return F.when(c.rlike(r"^[\p{L}\p{N}]$"), 1).when(c.rlike(r"^\S$"), 2).otherwise(0)


def _plain(kind: int, v: Column) -> Column:
    """v as a strict match would be written; phone numbers without country code or trunk zero."""
    if kind == 0:
        return F.regexp_replace(F.regexp_replace(v, r" ?(?:\(at\)|\[at\]| at ) ?", "@"), r" ?(?:\(dot\)|\[dot\]| dot ) ?", ".")
    if kind == 1:
        return F.regexp_replace(v, r"\[\.\]", ".")
    if kind == 2:
        return F.translate(v, "._/", "---")
    if kind == 4:
        return v
    return F.regexp_replace(v, r"^(?:\+[0-9]{1,3}(?![0-9])|\+[0-9]{1,2})?[ ().-]*0?", "")


def _featured(spans: Column, kind: int, strict: bool) -> Column:
    def one(x: Column, v: Column, valid: Column) -> Column:
        digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
        return F.struct(
            F.lit(kind).alias("kind"),
            x["s"].alias("s"),
            x["e"].alias("e"),
            (F.lit(strict) & valid).alias("strict"),
            valid.cast("int").alias("valid"),
            _bucket(digits, 1, 9, 12, 14, 17).alias("digits"),
            _bucket(F.length(F.regexp_replace(v, r"[\p{L}\p{N}]", "")), 1, 3, 5).alias("seps"),
            _bucket(F.length(v), 8, 12, 16, 24).alias("size"),
            reduce(lambda a, b: a + b, [v.rlike(rx).cast("int") for rx in FORMS[kind]]).alias("form"),
            x["pre"].rlike(CONTEXT[kind]).cast("int").alias("near"),
            _side(F.right(x["pre"], F.lit(1))).alias("before"),
            _side(x["post"]).alias("after"),
        )

    return F.transform(spans, lambda x: let(_plain(kind, x["v"]), lambda v: let(_valid(kind, x["v"]), lambda valid: one(x, v, valid))))


_SPAN = "struct<kind:int,s:bigint,e:bigint,strict:boolean,valid:int,digits:int,seps:int,size:int,form:int,near:int,before:int,after:int,over:boolean>"
_FAR = 1 << 62


def _overlaps(cands: Column) -> Column:
    """The candidates sorted by start, with over: whether one overlaps a strict span. Two sweeps: the furthest end of the
    strict spans that begin before, the next start of those that begin after."""
    sortable = F.transform(cands, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c.alias("c")))
    flagged = "struct<c:" + _SPAN.replace(",over:boolean", "") + ",over:boolean>"

    def forth(end: Column, x: Column) -> tuple[Column, Column]:
        c = x["c"]
        return F.when(c["strict"], F.greatest(end, c["e"])).otherwise(end), F.array(F.struct(c.alias("c"), (end > c["s"]).alias("over")))

    def back(start: Column, x: Column) -> tuple[Column, Column]:
        c = x["c"]
        fields = [c[f].alias(f) for f in ("kind", "s", "e", "strict", *FEATURES[1:])]
        return F.when(c["strict"], F.least(start, c["s"])).otherwise(start), F.array(F.struct(*fields, (~c["strict"] & (x["over"] | (start < c["e"]))).alias("over")))

    once = let(F.array_sort(sortable), lambda x: fold_append(x, F.lit(-1).cast("long"), forth, flagged))
    return let(F.reverse(once), lambda x: F.reverse(fold_append(x, F.lit(_FAR).cast("long"), back, _SPAN)))


def candidates(docs: DataFrame, *keep: Column) -> DataFrame:
    """The columns keep and cands: all candidates in docs' text, in the order of their starts, with their features.

    Null and empty texts have none. Each input row is handled by itself; whole texts are searched. Positions are folded in
    blocks, so a text that is full of matches takes little more than its length.
    """
    text = F.col("its text")
    found, names = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("its text")), []
    kept = found.columns[:-1]
    for strict, rxs, gates in ((True, STRICT, GATES), (False, LOOSE, LOOSE_GATES)):
        for kind, rx in enumerate(rxs):
            match = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
            if gates[kind]:
                match = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(g)) for g in gates[kind]]), match).otherwise(F.array().cast("array<string>"))
            names.append((f"matches {len(names)}", kind, rx, strict, match))
    found = found.withColumns({n: m for n, _, _, _, m in names})
    found = found.withColumns({n.replace("matches", "places"): _located(text, F.col(n), rx) for n, _, rx, _, _ in names})
    cands = F.concat(*[_featured(F.col(n.replace("matches", "places")), kind, strict) for n, kind, _, strict, _ in names])
    found = found.select(*kept, cands.alias("cands"))
    return found.select(*kept, F.when(F.size("cands") > 0, _overlaps(F.col("cands"))).otherwise(F.array().cast(f"array<{_SPAN}>")).alias("cands"))


@dataclass(frozen=True)
class Model:
    trees: Boosted
    thresholds: tuple[float, ...]


#: What is planted: kind, whether it is personal data, the words before it, and the span. # stands for a digit, ^ for a hexadecimal one, *
#: for a small letter, ? and ! for a letter or digit (! a large one), % for the right check digit and & for a wrong one.
PLANTED = (
    (0, True, "mail ", "****** (at) ***** (dot) com"),
    (0, True, "", "****[at]*******[dot]org"),
    (0, True, "write to ", "***** at ****** dot de"),
    (0, False, "", "***** at **** dot ******"),
    (0, False, "look ", "*** at *** dot *****"),
    (1, True, "", "2001:db8:^^^^:^^^^:^^^:^^^^:^^^^:a^^^"),
    (1, True, "server ", "1##[.]##[.]1##[.]#"),
    (1, True, "", "##[.]1##[.]#[.]1##"),
    (1, False, "", "##:##:##:##:##:##:##:##"),
    (1, False, "", "9##[.]##[.]1##[.]8##"),
    (2, True, "card ", "4###.####.####.###%"),
    (2, True, "", "5###_####_####_###%"),
    (2, True, "card 12 ", "4##############%"),
    (2, True, "31 ", "5##############%"),
    (2, False, "", "4###.####.####.###&"),
    (2, False, "no ", "4##############&"),
    (3, True, "call ", "(###) ###-####"),
    (3, True, "", "(###) ###-####"),
    (3, True, "phone ", "0## #### ####"),
    (3, True, "fax ", "0###/####-##"),
    (3, True, "tel ", "###-###-####"),
    (3, True, "", "###.###.####"),
    (3, False, "sum ", "###-##-#####"),
    (3, False, "", "###.####.##"),
    (3, False, "", "0## ### ### ###"),
    (3, False, "page ", "0#.0#.20##"),
    (4, True, "token = '", "^" * 40),
    (4, True, "password=", "^" * 18),
    (4, True, "secret: ", "?" * 24),
    (4, True, "api_key = ", "?" * 32),
    (4, True, "", "AKIA" + "!" * 16),
    (4, True, "", "ghp_" + "?" * 36),
    (4, True, "key ", "sk-" + "?" * 40),
    (4, False, "commit ", "^" * 40),
    (4, False, "sum ", "^" * 32),
    (4, False, "etag ", "^" * 64),
    (4, False, "secret: ", "********-*********-#"),
    (4, False, "token: ", "*******/******_*****#"),
)


def _filled(template: Column, seed: Column) -> Column:
    """The template with characters by the hash of seed in their places."""
    hexes = F.concat(*[F.sha2(F.concat_ws(":", seed, F.lit(i)).cast("binary"), 256) for i in range(2)])

    def one(c: Column, h: Column) -> Column:
        letter = F.translate(h, "01234567", "GhJkMnPq")
        made = F.when(c == "#", F.translate(h, "abcdef", "246813")).when(c == "^", h).when(c == "*", F.translate(h, "0123456789", "rstuvwxyzm"))
        return made.when(c == "?", letter).when(c == "!", F.upper(letter)).otherwise(c)

    chars = F.split(template, "")
    span = F.array_join(F.zip_with(chars, F.slice(F.split(hexes, ""), 1, F.size(chars)), one), "")

    def checked(v: Column) -> Column:
        off = let(F.reverse(F.concat(F.regexp_replace(v, "[^0-9]", ""), F.lit("0"))), _luhn_sum)
        digit = lambda more: F.pmod(F.lit(more) - off, F.lit(10)).cast("string")
        return F.when(v.rlike("[%&]"), F.replace(F.replace(v, F.lit("%"), digit(0)), F.lit("&"), digit(3))).otherwise(v)

    return let(span, checked)


def contexts(docs: DataFrame) -> DataFrame:
    """One row, contexts: STRETCH characters from somewhere in each of CONTEXTS different texts, by hash; none, if docs is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.xxhash64(text, F.lit(5))
    at = F.pmod(F.xxhash64(text, F.lit(9)), F.greatest(F.length(text) - STRETCH, F.lit(1)).cast("long")).cast("int")
    some = docs.select(mark.alias("mark"), F.substr(text, at + 1, F.lit(STRETCH)).alias("context")).distinct().orderBy("mark", "context").limit(CONTEXTS)
    return some.agg(F.array_sort(F.collect_list("context")).alias("contexts")).where(F.size("contexts") > 0)


def plants(docs: DataFrame, salt: int = 0) -> DataFrame:
    """kind, personal, s, e, held, text: PLANTS rows of each form in stretches of docs' texts; the same for the same texts. No rows for no
    docs; null and empty texts give empty stretches."""
    rows = contexts(docs).select("contexts", F.explode(F.sequence(F.lit(0), F.lit(PLANTS - 1))).alias("j"))
    stretch = F.element_at("contexts", F.pmod(F.col("j"), F.size("contexts")) + 1)
    forms = [F.struct(*[F.lit(v).alias(f) for f, v in zip(("no", "kind", "personal", "cue", "template"), (no, *form))]) for no, form in enumerate(PLANTED)]
    rows = rows.select("j", stretch.alias("stretch"), F.explode(F.array(*forms)).alias("p"))
    rows = rows.withColumn("span", _filled(F.col("p.template"), F.concat_ws(":", F.lit(salt), "j", "p.no")))
    half = STRETCH * 2 // 3
    start = F.concat(F.substring("stretch", 1, half), F.lit(" "), F.col("p.cue"))
    end = F.element_at(F.array(*[F.lit(x) for x in (" ", ". ", ", ", "\n", "' ")]), F.pmod(F.col("j") + F.col("p.no"), F.lit(5)) + 1)
    s = F.length(start).cast("long")
    held = F.pmod(F.col("j"), F.lit(FOLDS)) == FOLDS - 1
    return rows.select("p.kind", "p.personal", s.alias("s"), (s + F.length("span")).alias("e"), held.alias("held"), F.concat(start, "span", end, F.substring("stretch", half + 1, STRETCH)).alias("text"))


def with_plants(docs: DataFrame, *keep: Column) -> DataFrame:
    """keep, cands and its plant of all rows of docs (its plant is null) and of the plants in their texts (keep is null). All go through
    one and the same search; the result must be cut before use."""
    planted = cut(plants(docs)).select(F.struct("kind", "personal", "s", "e", "held").alias("its plant"), "text")
    rows = docs.select(*keep, F.lit(None).cast(planted.schema["its plant"].dataType).alias("its plant"), F.col("text"))
    rows = rows.unionByName(planted, allowMissingColumns=True)
    return candidates(rows, *[F.col(c) for c in rows.columns[:-1]])


def labelled(found: DataFrame) -> DataFrame:
    """c (candidate), label, held from the plants in found: a planted span that a generator found as it was planted is 1, what
    overlaps a decoy is 0; base spans, which stay whatever the trees say, and what lies elsewhere are left out."""
    c = found.where(F.col("its plant").isNotNull()).select("its plant", F.explode("cands").alias("c"))
    own = lambda f: F.col("its plant")[f]
    exact = (F.col("c.kind") == own("kind")) & (F.col("c.s") == own("s")) & (F.col("c.e") == own("e"))
    meets = (F.col("c.s") < own("e")) & (F.col("c.e") > own("s"))
    c = c.where(~(F.col("c.strict") & (F.col("c.kind") < 4)) & F.when(own("personal"), exact).otherwise(meets))
    return c.select("c", own("personal").cast("int").alias("label"), own("held").alias("held"))


def _counted(rows: DataFrame, label: Column, *by: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, numbers of rows and of positives, and by, of the candidates c; bounded by the features' ranges."""
    table = rows.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES], *by).agg(F.count("*").alias("rows of it"), F.sum(label).alias("good of it")).collect()
    table = np.array(sorted(tuple(float(v) for v in r) for r in table)).reshape(-1, len(FEATURES) + len(by) + 2)
    return table[:, : len(FEATURES)].astype(int), table[:, -2], table[:, -1], table[:, len(FEATURES) : -2]


def train(found: DataFrame, precision: float = PRECISION) -> Model:
    """Trees and thresholds from the plants and from all candidates of all rows of with_plants(); a kind whose held-out plants don't
    reach the precision gets nothing added, and so do all kinds without docs."""
    x, n, pos, held = _counted(labelled(found), F.col("label"), F.col("held").cast("int").alias("held"))
    held = held[:, 0] == 1
    apart = F.filter("cands", lambda c: F.when(c["strict"], c["kind"] < 4).otherwise((c["valid"] == 0) | ~c["over"]))
    seen, rows, base, _ = _counted(found.where(F.col("its plant").isNull()).select(F.explode(apart).alias("c")), F.col("c.strict").cast("int"))
    rows = base + (rows - base) * np.where(seen[:, FEATURES.index("valid")] == 1, UNLABELLED, 1.0)
    share = min(1.0, n[~held].sum() / max(rows.sum(), 1.0))
    trees = fit(FEATURES, np.concatenate([x[~held], seen]), np.concatenate([n[~held], share * rows]), np.concatenate([pos[~held], share * base]))
    score, thresholds = trees.predict(x), []
    for kind in range(len(KINDS)):
        own = held & (x[:, 0] == kind) & (x[:, FEATURES.index("valid")] == 1)
        level = [s for s in np.unique(score[own]) if pos[own & (score >= s)].sum() >= precision * n[own & (score >= s)].sum()]
        thresholds.append(float(level[0]) - 1e-9 if level else 2.0)
    return Model(trees, tuple(thresholds))


_FOUND = "struct<kind:int,s:bigint,e:bigint,base:boolean,strict:boolean,score:double>"


def spans_column(model: Model) -> Column:
    """Of the column cands: kind (number), s, e, base, strict, score, sorted by kind and start: base spans and those that
    pass. Of loose spans that overlap one another, the first of the longest stays."""
    limit = lambda kind: F.element_at(F.array(*[F.lit(t) for t in model.thresholds]), kind + 1)
    scored = F.transform("cands", lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("minus_e"), c["kind"].alias("kind"), c["strict"].alias("strict"), (~c["over"] & (c["valid"] == 1)).alias("free"), model.trees.column(c).alias("score")))
    passing = F.filter(scored, lambda c: (c["strict"] & (c["kind"] < 4)) | ((c["strict"] | c["free"]) & (c["score"] >= limit(c["kind"]))))

    def choose(end: Column, x: Column) -> tuple[Column, Column]:
        e = -x["minus_e"]
        one = F.struct(x["kind"].alias("kind"), x["s"].alias("s"), e.alias("e"), (x["strict"] & (x["kind"] < 4)).alias("base"), x["strict"].alias("strict"), x["score"].alias("score"))
        stays = x["strict"] | (x["s"] >= end)
        return F.when(~x["strict"] & stays, e).otherwise(end), F.when(stays, F.array(one)).otherwise(F.array().cast(f"array<{_FOUND}>"))

    spans = let(F.array_sort(passing), lambda x: F.array_sort(fold_append(x, F.lit(-1).cast("long"), choose, _FOUND)))
    return F.when(F.size("cands") > 0, spans).otherwise(F.array().cast(f"array<{_FOUND}>"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row; the candidates are found once, kept in the checkpoint folder, and scored from there."""
    found = cut(with_plants(docs, F.col("doc_id")))
    return found.where(F.col("its plant").isNull()).select("doc_id", spans_column(train(found)).alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from find()."""
    named = lambda c: F.concat(F.element_at(F.array(*[F.lit(k) for k in KINDS]), c["kind"] + 1), F.lit(":"), c["s"].cast("string"), F.lit(":"), c["e"].cast("string"))
    base = F.filter("spans", lambda c: c["base"])
    of_kind = lambda k: F.filter("spans", lambda c: c["base"] & (c["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    sha = F.sha2(F.array_join(F.transform(base, named), ",").cast("binary"), 256)
    return find(docs).select("doc_id", *counts, sha.alias("base_sha256"), F.array_join(F.transform("spans", named), ",").alias("spans"))


def _redacted(text: Column, spans: Column) -> Column:
    """text with its spans replaced. Spans that overlap are removed together and named by the first. The text between two
    blocks of spans is taken out once, so that no span looks through the whole text."""
    order = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("minus_e"), c["kind"].alias("kind"))))
    hole = "struct<s:bigint,e:bigint,label:string>"

    def apart(end: Column, x: Column) -> tuple[Column, Column]:
        e = -x["minus_e"]
        label = F.concat(F.lit("["), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)), F.lit("]"))
        fresh = x["s"] >= end
        gap = F.struct(F.greatest(x["s"], end).alias("s"), e.alias("e"), F.when(fresh, label).otherwise(F.lit("")).alias("label"))
        return F.greatest(end, e), F.when(e > end, F.array(gap)).otherwise(F.array().cast(f"array<{hole}>"))

    holes = let(order, lambda x: fold_append(x, F.lit(0).cast("long"), apart, hole))

    def stretch(acc: Column, some: Column) -> Column:
        """One block: the text from where the last block ended to where this one ends, with its holes filled."""
        end = F.element_at(some, -1)["e"]
        piece = F.substr(text, (acc["at"] + 1).cast("int"), (end - acc["at"]).cast("int"))

        def fill(own: Column) -> Column:
            def one(a: Column, h: Column) -> Column:
                s, e = h["s"] - acc["at"], h["e"] - acc["at"]
                return F.struct(e.alias("at"), F.concat(a["out"], F.substr(own, (a["at"] + 1).cast("int"), (s - a["at"]).cast("int")), h["label"]).alias("out"))

            return F.aggregate(some, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), one, lambda a: a["out"])

        return F.struct(end.alias("at"), F.concat(acc["outs"], F.array(let(piece, fill))).alias("outs"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("outs"))
    whole = let(holes, lambda h: F.aggregate(blocks_of(h), start, stretch, lambda a: F.concat(F.array_join(a["outs"], ""), F.substr(text, (a["at"] + 1).cast("int")))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets, n_chars made to match; null texts stay null.

    Where spans overlap, the one that starts first (the longest of those) names the replacement and all are removed. All other
    columns stay, whatever their names. The candidates are found once; they and the rows are kept in the shared folder.
    """
    found = keep(with_plants(docs, as_row(docs).alias("row")))
    model = train(found)
    spanned = found.where(F.col("its plant").isNull()).select("row", spans_column(model).alias("spans"))
    done = spanned.select("row", _redacted(F.col("row")["text"], F.col("spans")).alias("new text"))
    out = []
    for c, column in zip(docs.columns, row_columns(docs, "row")):
        size = F.length("new text").cast(docs.schema[c].dataType) if c == "n_chars" else column
        out.append(F.col("new text").alias(c) if c == "text" else size.alias(c))
    return done.select(*out)
