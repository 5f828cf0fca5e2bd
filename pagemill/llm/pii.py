"""Personal data by boosted candidate spans (DataFrame functions only).

Fixed patterns with hard checks give the base spans, which always stay.  Wider
generators propose further spans, overlapping ones included: addresses with a
bracketed at or dot, dotted numbers with spaces, longer and shorter digit
chains, telephone numbers without a plus sign.

Every proposal is described by flags of its format and context and labelled by
its hard check (a checksum, a range, a digit count), which is no flag.  From
the counts of each flag combination, gradient-boosted oblivious trees of depth
two are grown, one aggregate a tree; only sums for pairs of flags reach the
driver, a number that doesn't depend on the data.  On a fifth of the ids, kept
out of growing, the least score whose proposals are right to ``precision`` is
each kind's threshold; a kind that never reaches it adds nothing.  Proposals at
or above it that touch no base span are added, the better of two that overlap.

Positions are code points, ends exclusive.

Defined cases: a very long text is scanned whole, its matches held in one array; of
equally good proposals that overlap the first in the text is taken; null and empty texts have no spans; a null ``doc_id`` is handled
as any other; repeated rows give repeated results; an empty table, or one with
no proposals, adds nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")

# Possessive where nothing could be given back; a run of local-part characters is entered at its start only.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to be tried: cheap and never false for a checked match.
_NEEDS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"(?:[0-9][\x20-]?){15}[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]",
}
_WIDE = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[\p{L}0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\p{L}0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:\x20?(?:\.|\[\.\])\x20?[0-9]{1,4}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,20}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
_WIDE_NEEDS = {
    "email": r"@|(?:\(at\)|\[at\])",
    "ip": r"[0-9]\x20?(?:\.|\[\.\])\x20?[0-9]",
    "card": r"[0-9](?:[\x20.-]?[0-9]){12}",
    "phone": r"[0-9)][\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3}",
}
_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    # Doubled digits from the right: 0 2 4 6 8 1 3 5 7 9.
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a
        + F.when(i % 2 == 1, F.substr(back, i, F.lit(1)).cast("int")).otherwise(F.substr(F.lit("0246813579"), F.substr(back, i, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int")),
    )
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def _octets(s: Column) -> Column:
    parts = F.split(F.regexp_replace(s, r"[\x20\[\]]", ""), r"\.")
    return F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))


def _checked(kind: str, s: Column) -> Column:
    """The hard check of a base match."""
    n = F.length(_digits(s))
    if kind == "ip":
        return _octets(s)
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(s))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _label(kind: str, s: Column) -> Column:
    """The hard check of a proposal."""
    n = F.length(_digits(s))
    if kind == "card":
        return n.between(13, 19) & luhn(_digits(s))
    if kind == "email":
        return F.regexp_extract(s, r"([\p{L}0-9-]+)$", 1).rlike(r"^[A-Za-z]{2,24}$")
    return _octets(s) if kind == "ip" else n.between(10, 13)


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """(s, start) of all matches, left to right; pieces and matches alternate, so lengths add up to starts."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    step = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))).alias("b")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:string,start:int>>").alias("out")),
        lambda a, z: F.struct(
            (a["at"] + F.length(z["b"]) + F.length(z["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(z["m"].alias("s"), (a["at"] + F.length(z["b"])).alias("start")))).alias("out"),
        ),
    )
    return F.when(text.rlike(needs), step["out"]).otherwise(F.array().cast("array<struct<s:string,start:int>>"))


def _flags(text: Column, s: Column, start: Column) -> list[Column]:
    """The format and context of a proposal."""
    end = start + F.length(s)
    before, after = F.when(start > 0, F.substr(text, start, F.lit(1))).otherwise(" "), F.substr(text, end + 1, F.lit(1))
    context = F.lower(F.substr(text, F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24))))
    n = F.length(_digits(s))
    return [
        s.startswith("+"), s.contains("("), s.contains("-"), s.contains("."), s.contains(" "), s.rlike(r"\[|\((?:at|dot)\)"),
        s.rlike(r"\p{L}"), n > 4, n > 8, n > 10, n > 12, n > 15, n > 16, s.rlike(r"^0"), s.rlike(r"^[3-6]"), s.rlike(r"[0-9]{4}[\x20-][0-9]{4}"),
        before.rlike(r"[\x20\x09-\x0D(\[,:;]"), (after == "") | after.rlike(r"[\x20\x09-\x0D)\],.;:]"), before.rlike(r"[\p{L}0-9]"),
        context.rlike(r"mail|contact|write"), context.rlike(r"tel|phone|call|fax|mobile|cell"), context.rlike(r"\bip\b|host|server|addr"), context.rlike(r"card|visa|credit|pay|iban"),
    ]


def _base_spans(k: int) -> Column:
    return F.transform(
        F.filter(f"b{k}", lambda m: _checked(KINDS[k], m["s"])),
        lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["s"])).alias("end")),
    )


def _proposals(k: int) -> Column:
    def described(m):
        bits = F.lit(0)
        for i, flag in enumerate(_flags(F.col("text"), m["s"], m["start"])):
            bits = bits + F.coalesce(flag, F.lit(False)).cast("int") * (1 << i)
        end = (m["start"] + F.length(m["s"])).alias("end")
        return F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), end, bits.alias("flags"), _label(KINDS[k], m["s"]).cast("int").alias("y"))

    return F.transform(f"w{k}", described)


def propose(docs: DataFrame) -> DataFrame:
    """doc_id, base (checked spans) and wide (proposals with flags and labels) of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k, kind in enumerate(KINDS):
        rows = rows.withColumn(f"b{k}", _matches(F.col("text"), _BASE[kind], _NEEDS[kind]))
        rows = rows.withColumn(f"w{k}", _matches(F.col("text"), _WIDE[kind], _WIDE_NEEDS[kind]))
    every = range(len(KINDS))
    return rows.select("doc_id", F.concat(*map(_base_spans, every)).alias("base"), F.concat(*map(_proposals, every)).alias("wide"))


N_FLAGS = 23


def _bit(flags: Column, i: int) -> Column:
    return F.shiftright(flags, i).bitwiseAND(1)


def _score(trees: list[tuple[int, int, tuple]], flags: Column) -> Column:
    total = F.lit(0.0)
    for i, j, leaves in trees:
        total = total + F.element_at(F.array(*[F.lit(float(v)) for v in leaves]), (2 * _bit(flags, i) + _bit(flags, j) + 1).cast("int"))
    return total


def boost(counts: DataFrame, *, rounds: int = 8, rate: float = 0.5, l2: float = 1.0) -> dict[int, list]:
    """Trees of each kind from ``counts`` (kind, flags, n, pos): Newton steps on the logistic loss."""
    trees: dict[int, list] = {k: [] for k in range(len(KINDS))}
    pairs = F.filter(F.sequence(F.lit(0), F.lit(N_FLAGS * N_FLAGS - 1)), lambda p: p % N_FLAGS <= F.floor(p / N_FLAGS))
    for _ in range(rounds):
        score = F.coalesce(*[F.when(F.col("kind") == k, _score(t, F.col("flags"))) for k, t in trees.items()])
        p = 1 / (1 + F.exp(-score))
        leaf = f"2 * (shiftright(flags, cast(ij % {N_FLAGS} AS int)) & 1) + (shiftright(flags, cast(floor(ij / {N_FLAGS}) AS int)) & 1)"
        sums = (
            counts.select("kind", "flags", (F.col("pos") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), F.explode(pairs).alias("ij"))
            .groupBy("kind", "ij", F.expr(leaf).alias("leaf"))
            .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        )
        table: dict = {}
        for r in sums.collect():  # at most 4 kinds x 276 pairs x 4 leaves, whatever the data
            table.setdefault((r["kind"], r["ij"]), {})[r["leaf"]] = (r["g"], r["h"])
        for k in trees:
            own = [(round(sum(g * g / (h + l2) for g, h in leaves.values()), 9), -ij, leaves) for (kind, ij), leaves in table.items() if kind == k]
            if own:
                _, ij, leaves = max(own, key=lambda x: x[:2])
                value = tuple(rate * leaves[q][0] / (leaves[q][1] + l2) if q in leaves else 0.0 for q in range(4))
                trees[k].append((-ij % N_FLAGS, -ij // N_FLAGS, value))
    return trees


def thresholds(counts: DataFrame, trees: dict[int, list], precision: float) -> dict[int, float]:
    """For each kind the least score down to which proposals are right to ``precision``."""
    score = F.round(F.coalesce(*[F.when(F.col("kind") == k, _score(t, F.col("flags"))) for k, t in trees.items()]), 9)
    by = counts.groupBy("kind", score.alias("score")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    down = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    good = by.withColumn("right", F.sum("pos").over(down) / F.sum("n").over(down)).where(F.col("right") >= precision)
    return {r["kind"]: r["low"] for r in good.groupBy("kind").agg(F.min("score").alias("low")).collect()}


def find(docs: DataFrame, *, precision: float = 0.99, rounds: int = 8) -> DataFrame:
    """doc_id, base and spans of every row; kind is the place in ``KINDS``."""
    rows = materialize(propose(docs), "proposals")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    counts = rows.select(fold.alias("fold"), F.explode("wide").alias("w")).groupBy("fold", "w.kind", "w.flags").agg(F.count("*").alias("n"), F.sum("w.y").alias("pos"))
    counts = materialize(counts, "flags")
    trees = boost(counts.where("NOT fold"), rounds=rounds)
    low = thresholds(counts.where("fold"), trees, precision)
    if not low:
        return rows.select("doc_id", "base", F.array_sort("base").alias("spans"))
    scored = F.transform(
        "wide",
        lambda w: F.struct(
            w["kind"].alias("kind"), w["start"].alias("start"), w["end"].alias("end"),
            F.round(F.coalesce(*[F.when(w["kind"] == k, _score(trees[k], w["flags"])) for k in low], F.lit(-1e9)), 9).alias("score"),
            F.coalesce(*[F.when(w["kind"] == k, F.lit(float(v))) for k, v in low.items()], F.lit(1e9)).alias("least"),
        ),
    )
    free = F.filter(scored, lambda w: (w["score"] >= w["least"]) & ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    rows = rows.withColumn("free", free)
    rank = lambda w: F.struct(w["score"], -w["start"], -w["kind"])
    best = F.filter("free", lambda w: ~F.exists("free", lambda x: (x["start"] < w["end"]) & (w["start"] < x["end"]) & (rank(x) > rank(w))))
    added = F.transform(best, lambda w: F.struct(w["kind"].alias("kind"), w["start"].alias("start"), w["end"].alias("end")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans merge into the first."""
    names = F.array(*map(F.lit, KINDS))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(
        by_start,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")).alias("out")),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
    )
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))
