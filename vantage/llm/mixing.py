"""Mixing sources to target weights: a hierarchical token budget and seeded epochs, in DataFrame operations only.

Weights propagate down a domain-language-source tree. Each node's budget is dealt to its children by weight; a child that
cannot use its share (its tokens times the allowed epochs are fewer) takes what it can and its siblings share the rest by
weight. Capacities are summed over subtrees, so a shortage moves to the ancestors' other branches only once all siblings
are full. A leaf with budget b and t tokens is read b div t whole times, and its next epoch, in the order of a hash
seeded with the epoch, gives the longest prefix of documents that fits the remaining b mod t tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vantage.llm.common import cut, hash60, join_small, literal_map, table

LEVELS = ["domain", "language", "source"]
#: Target weights by level; a name that is not listed has weight 1. On a level without weights each name weighs its tokens.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "language": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
MAX_EPOCHS, SEED = 4, 17
#: Documents of a leaf that fall in one range of the epoch's order, about.
RANGE_ROWS = 256
LAST = (1 << 60) - 1


def domain_of(source: Column) -> Column:
    """The domain of a source: its trailing number modulo 4; sources without one form a domain of their own."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), (F.when(number != "", number).cast("long") % 4).cast("string")))


def token_count(text: Column) -> Column:
    """Words parted by spaces, tabs and line ends; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\x0b\f]+")), F.lit(0)).cast("long")


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent columns, name, weight, cap, budget (the parent's). Adds got: what each child may use, in whole tokens.

    Saturated are the children, by rising cap/weight, that the budget fills up while the others get as much per weight.
    """
    ratio = F.col("cap") / F.col("weight")
    order = W.partitionBy(*parent).orderBy("ratio", name) if parent else W.orderBy("ratio", name)
    whole = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    n = nodes.where("weight > 0").withColumn("ratio", ratio)
    n = n.withColumn("c", F.sum("cap").over(upto)).withColumn("after", F.sum("weight").over(whole) - F.sum("weight").over(upto))
    n = n.withColumn("sat", F.col("c") + F.col("ratio") * F.col("after") <= F.col("budget"))
    n = n.withColumn("rem", F.col("budget") - F.sum(F.when(F.col("sat"), F.col("cap")).otherwise(0)).over(whole))
    n = n.withColumn("open", F.sum(F.when(~F.col("sat"), F.col("weight")).otherwise(0)).over(whole))
    share = F.floor(F.col("rem").cast("double") * F.col("weight") / F.col("open"))
    got = F.when(F.col("sat"), F.col("cap")).otherwise(F.least("cap", F.greatest(F.lit(0).cast("long"), share)))
    return n.withColumn("got", got.cast("long")).drop("ratio", "c", "after", "sat", "rem", "open")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int | None, max_epochs: int) -> DataFrame:
    """leaves: LEVELS, t (tokens). Adds got: each leaf's budget in tokens. budget null: as many tokens as there are."""
    leaves = leaves.withColumn("cap", F.col("t") * max_epochs)
    given = leaves.groupBy().agg((F.lit(budget) if budget is not None else F.sum("t")).cast("long").alias("budget"))
    for i, name in enumerate(LEVELS):
        keys = LEVELS[: i + 1]
        listed = weights.get(name)
        weight = F.coalesce(F.element_at(literal_map(listed), F.col(name)), F.lit(1)).cast("long") if listed else F.col("tokens")
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("t").alias("tokens")).withColumn("weight", weight)
        nodes = nodes.join(given, LEVELS[:i]) if i else nodes.join(F.broadcast(given))  # one row
        given = water_fill(nodes, LEVELS[:i], name).select(*keys, F.col("got").alias("budget"))
    return leaves.join(given.withColumnRenamed("budget", "got"), LEVELS, "left").withColumn("got", F.coalesce("got", F.lit(0))).drop("cap")


def narrow(docs: DataFrame, doc_id: str, text: str, language: str, source: str) -> DataFrame:
    """(LEVELS, doc_id, tie, n_tokens): nulls in the tree's columns become the name "-"."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return docs.select(domain_of(F.col(source).cast("string")).alias("domain"), name(language).alias("language"), name(source).alias("source"), F.col(doc_id).alias("doc_id"), hash60(F.col(text)).alias("tie"), token_count(F.col(text)).alias("n_tokens"))


def order_key(epoch: Column, seed: int) -> Column:
    return hash60(F.lit(str(seed)), epoch, F.col("doc_id"))


def plan(rows: DataFrame, weights: dict[str, dict[str, int]], budget: int | None, max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: LEVELS, got, whole (full epochs), cut_key and cut_tie: the last place of the prefix of the next epoch."""
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")))
    most = leaves.agg(F.max("n")).first()[0] or 1
    shift = 60 - min(30, max(0, math.ceil(math.log2(most / RANGE_ROWS))))
    leaf = budgets(leaves.drop("n"), weights, budget, max_epochs)
    whole = F.when(F.col("t") > 0, F.expr("got div t")).otherwise(F.lit(0)).cast("long")
    leaf = cut(leaf.withColumn("whole", whole).withColumn("rest", F.col("got") - F.col("whole") * F.col("t")))
    keyed = join_small(rows, leaf.select(*LEVELS, "whole", "rest"), LEVELS).withColumn("key", order_key(F.col("whole"), seed))
    keyed = keyed.withColumn("range", F.shiftright("key", shift))
    sums = keyed.groupBy(*LEVELS, "range", "rest").agg(F.sum("n_tokens").alias("s"))
    upto = W.partitionBy(*LEVELS).orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    # the first range that does not fit as a whole; those before it do
    over = sums.withColumn("c", F.sum("s").over(upto)).where("c > rest").groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("c") - F.col("s")).alias("before"))).alias("o"))
    over = cut(over.select(*LEVELS, "o.range", "o.before"))
    inside = join_small(keyed, over, [*LEVELS, "range"])
    running = F.col("before") + F.sum("n_tokens").over(W.partitionBy(*LEVELS).orderBy("key", "tie").rangeBetween(W.unboundedPreceding, W.currentRow))
    last = inside.withColumn("c", running).where("c <= rest").groupBy(*LEVELS).agg(F.max(F.struct("key", "tie")).alias("l"))
    found = leaf.join(over, LEVELS, "left").join(last, LEVELS, "left")
    key = F.when(F.col("range").isNull(), F.lit(LAST)).otherwise(F.coalesce(F.col("l.key"), F.shiftleft("range", shift) - 1))
    tie = F.when(F.col("range").isNull(), F.lit(LAST)).otherwise(F.coalesce(F.col("l.tie"), F.lit(LAST)))
    return cut(found.select(*LEVELS, "got", "whole", key.alias("cut_key"), tie.alias("cut_tie")))


def select(rows: DataFrame, leaf: DataFrame, seed: int) -> DataFrame:
    """rows (with LEVELS, doc_id, tie) once per epoch that reads them, with the number of that epoch."""
    at = join_small(rows, leaf, LEVELS).withColumn("__key", order_key(F.col("whole"), seed))
    within = (F.col("__key") < F.col("cut_key")) | ((F.col("__key") == F.col("cut_key")) & (F.col("tie") <= F.col("cut_tie")))
    times = F.col("whole") + F.when(within, 1).otherwise(0)
    return at.withColumn("__n", times).where("__n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source", weights: dict | None = None, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs' rows, each as often as the epochs of its leaf read it.

    Null or empty texts weigh nothing: they go with the prefix they fall in, and a leaf without any token is read once.
    Equal places in an epoch (repeated ids) are ordered by a hash of the text; exact repeats of id and text stand or
    fall together.
    A name of weight 0 gets nothing but documents without tokens at the head of its order. An empty table gives no rows.
    """
    weights = WEIGHTS if weights is None else weights
    leaf = plan(cut(narrow(docs, doc_id, text, language, source)), weights, budget, max_epochs, seed)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    rows = docs.select(whole, domain_of(docs[source].cast("string")).alias("domain"), name(language).alias("language"), name(source).alias("source"), docs[doc_id].alias("doc_id"), hash60(docs[text]).alias("tie"))
    return select(rows, leaf, seed).select("__row.*")


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(narrow(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source"))
    chosen = select(rows, plan(rows, WEIGHTS, None, MAX_EPOCHS, SEED), SEED)
    return chosen.select("doc_id", "domain", "language", "source", "n_tokens", "epoch", F.col("got").alias("leaf_budget"))


def mixing_sql(weights: dict | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    weights = WEIGHTS if weights is None else weights
    h = "('0x' || substr(md5({}), 1, 15))::BIGINT"

    def fill(i: int) -> str:
        keys, above = ", ".join(LEVELS[: i + 1]), ", ".join(LEVELS[:i])
        case = "".join(f" WHEN '{k}' THEN {w}" for k, w in weights.get(LEVELS[i], {}).items())
        weight = f"CASE {LEVELS[i]}{case} ELSE 1 END" if case else "sum(t)::BIGINT"
        part, using = (f"PARTITION BY {above}", f"JOIN g{i} USING ({above})") if i else ("", "CROSS JOIN g0")
        return f"""
        n{i} AS (SELECT {keys}, budget, cap, w, cap / w AS ratio FROM (SELECT {keys}, sum(t * {max_epochs})::BIGINT AS cap, {weight} AS w FROM leaf GROUP BY {keys}) {using} WHERE w > 0),
        c{i} AS (SELECT *, sum(cap) OVER o + ratio * (sum(w) OVER ({part}) - sum(w) OVER o) <= budget AS sat FROM n{i} WINDOW o AS ({part} ORDER BY ratio, {LEVELS[i]} ROWS UNBOUNDED PRECEDING)),
        g{i + 1} AS (SELECT {keys}, (CASE WHEN sat THEN cap ELSE least(cap, greatest(0, floor((budget - sum(if(sat, cap, 0)) OVER ({part}))::DOUBLE * w / nullif(sum(if(sat, 0, w)) OVER ({part}), 0)))) END)::BIGINT AS budget FROM c{i})"""

    return f"""
        WITH r AS (
            SELECT doc_id, text, coalesce(lang, '-') AS language, coalesce(source, '-') AS source,
                CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other' ELSE 'domain' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) END AS domain,
                coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\f]+')), 0)::BIGINT AS n_tokens, {h.format("coalesce(text, '')")} AS tie FROM documents),
        leaf AS (SELECT domain, language, source, sum(n_tokens)::BIGINT AS t FROM r GROUP BY ALL),
        g0 AS (SELECT sum(t)::BIGINT AS budget FROM leaf),{",".join(fill(i) for i in range(3))},
        l AS (SELECT leaf.*, coalesce(budget, 0) AS got, if(t > 0, coalesce(budget, 0) // t, 0) AS whole FROM leaf LEFT JOIN g3 USING (domain, language, source)),
        k AS (SELECT r.*, got, whole, got - whole * t AS rest, {h.format(f"'{seed}' || chr(31) || whole::VARCHAR || chr(31) || coalesce(doc_id::VARCHAR, '')")} AS key FROM r JOIN l USING (domain, language, source)),
        s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY key, tie RANGE UNBOUNDED PRECEDING) AS c FROM k)
        SELECT doc_id, domain, language, source, n_tokens, unnest(range(0, whole + if(c <= rest, 1, 0)))::BIGINT AS epoch, got::BIGINT AS leaf_budget FROM s"""
