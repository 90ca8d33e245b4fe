"""Operator 6: mixing sources to target weights by hierarchical budgeting.

The tree is domain -> language -> source. A token budget enters at the root; every node divides what
it got among its children by weight. A child whose subtree holds too little (all epochs included)
is filled, and what it leaves is shared by its siblings first; only when all siblings are full does the
rest reach the parent's siblings. Each leaf then takes a prefix of its token stream: epoch after epoch,
each in its own seeded order.

Everything is native Spark. The order within a leaf is by md5(seed, epoch, doc_id), cut into 4096 key
ranges whose sums come first, so that even a leaf with most of the corpus is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import materialise, own_columns, safe_name

LEVELS = ("domain", "lang", "source")
#: Sources belong to one of three domains by their number; sources without a number to "other".
DOMAIN_SQL = "coalesce(concat('domain', CAST(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 AS VARCHAR(4))), 'other')"
DOMAIN_WEIGHTS = {"domain0": 5, "domain1": 3, "domain2": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SEED, RATIO, MAX_EPOCHS = 7, 0.8, 2


def token_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, form feed and carriage return; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\f\r]+")), F.lit(0)).cast("long")


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, v in weights.items():
        out = out.when(F.col(name) == k, F.lit(int(v)))
    return out.otherwise(F.lit(1)).cast("long")


def fill(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Divide ``budget`` of each parent among its children: min(cap, weight x level), with one level per parent at
    which the sum meets the budget. nodes: the parent's columns, ``child``, ``cap``, ``weight``, ``budget``.
    Adds ``got``, in whole tokens."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    step = nodes.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    first_open = F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(Window.partitionBy(*parent))
    return (step.withColumn("open_level", first_open)
            .withColumn("got", F.when(F.col("open_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.greatest(F.col("open_level"), F.lit(0.0)) * F.col("weight")))).cast("long"))
            .drop("level", "open_level"))


def budgets(leaves: DataFrame, ratio: float, max_epochs: int, domain_weights: dict[str, int], lang_weights: dict[str, int], source_weights: dict[str, int]) -> DataFrame:
    """leaves: domain, lang, source, tokens -> the same with ``got``. Weights are positive whole numbers; a name that
    isn't listed weighs 1, and one with weight 0 gets nothing."""
    tables = {"domain": domain_weights, "lang": lang_weights, "source": source_weights}
    nodes = leaves.where(F.col("tokens") > 0)
    for level, weights in tables.items():
        nodes = nodes.withColumn(f"w_{level}", _weight(level, weights)).where(F.col(f"w_{level}") > 0)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(ratio))).cast("long").alias("budget"))
    nodes = nodes.withColumn("cap", F.col("tokens") * F.lit(int(max_epochs)))
    parent: list[str] = []
    above = None
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        at = nodes.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").alias("weight"))
        if above is None:
            at = at.crossJoin(total)
        else:
            at = at.join(above.select(*parent, F.col("got").alias("budget")), parent)
        above = fill(at, parent, level)
        parent = keys
    return leaves.join(above.select(*LEVELS, "got"), list(LEVELS), "left").withColumn("got", F.coalesce("got", F.lit(0)))


def select_mixture(docs: DataFrame, ratio: float = RATIO, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS, source_weights: dict[str, int] | None = None, domain_sql: str = DOMAIN_SQL) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, copies) of every document that is taken at least once.

    The budget is ``ratio`` of all tokens. copies: the whole epochs of the document's leaf, and one more if the
    document lies wholly in the prefix that the last epoch gives; the budget is never exceeded.
    NULL in lang or source is a child of its own, named ''; a NULL text has no tokens and is never taken, nor is an
    empty one; a NULL doc_id is ordered as ''. Rows with the same doc_id in a leaf have one place in the order and are
    in or out together. A very long text counts whole, and is left out where it alone passes what is left. An empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), token_count(F.col("text")).alias("tokens"))
    rows = materialise(rows.select("doc_id", F.expr(domain_sql).alias("domain"), "lang", "source", "tokens"))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, ratio, max_epochs, domain_weights, lang_weights, source_weights or {}).where(F.col("tokens") > 0)
    plan = plan.select(*LEVELS, F.expr("got div tokens").alias("epochs"), F.expr("got % tokens").alias("rest"))
    keyed = rows.where(F.col("tokens") > 0).join(plan, list(LEVELS)).withColumn("place", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("part", F.substring("place", 1, 3))
    parts = keyed.groupBy(*LEVELS, "part").agg(F.sum("tokens").alias("held"))
    parts = parts.withColumn("start", F.coalesce(F.sum("held").over(Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
    within = Window.partitionBy(*LEVELS, "part").orderBy("place")
    placed = keyed.join(parts, [*LEVELS, "part"]).withColumn("end", F.col("start") + F.sum("tokens").over(within))
    return placed.withColumn("copies", F.col("epochs") + (F.col("end") <= F.col("rest")).cast("long")).where(F.col("copies") > 0).select("doc_id", *LEVELS, "tokens", "copies")


def apply_mixture(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as select_mixture() takes it; columns as they came. Equal rows keep their number."""
    taken = select_mixture(docs, **options).select(F.col("doc_id").alias("_mix_id"), F.col("lang").alias("_mix_lang"), F.col("source").alias("_mix_source"), F.col("tokens").alias("_mix_tokens"), F.col("copies").alias("_mix_copies")).distinct()
    again = safe_name(docs, "mix_copy")
    out = docs.join(taken, docs["doc_id"].eqNullSafe(taken["_mix_id"]) & (F.coalesce(docs["lang"], F.lit("")) == taken["_mix_lang"]) & (F.coalesce(docs["source"], F.lit("")) == taken["_mix_source"]) & (token_count(docs["text"]) == taken["_mix_tokens"]))
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), taken["_mix_copies"].cast("int")))).select(*own_columns(docs).values())


def _cases(name: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _fill_sql(nodes: str, parent: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    child = LEVELS[parent.count(",") + 1 if parent else 0]
    keys = ", ".join(x for x in (parent, child) if x)
    return f"""SELECT {keys}, CASE WHEN lv IS NULL THEN cap ELSE least(cap, CAST(floor(greatest(lv, 0.0) * weight) AS BIGINT)) END AS got FROM (
      SELECT *, max(CASE WHEN cap::DOUBLE / weight > step THEN step END) OVER ({by}) AS lv FROM (
        SELECT *, (budget - coalesce(sum(cap) OVER ({by} ORDER BY cap::DOUBLE / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / sum(weight) OVER ({by} ORDER BY cap::DOUBLE / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM ({nodes})))"""


def mixture_sql(ratio: float = RATIO, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """select_mixture() over the table ``documents`` as DuckDB SQL."""
    domain = DOMAIN_SQL.replace("VARCHAR(4)", "VARCHAR")
    return f"""
    WITH docs AS (SELECT doc_id, coalesce({domain}, 'other') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\f\\r]+')), 0)::BIGINT AS tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, {max_epochs} * sum(tokens)::BIGINT AS cap FROM docs GROUP BY ALL HAVING sum(tokens) > 0),
    a AS ({_fill_sql(f"SELECT domain, sum(cap)::BIGINT AS cap, {_cases('domain', DOMAIN_WEIGHTS)} AS weight, (SELECT CAST(floor(coalesce(sum(tokens), 0)::DOUBLE * {ratio}::DOUBLE) AS BIGINT) FROM docs) AS budget FROM leaves GROUP BY domain", "")}),
    b AS ({_fill_sql(f"SELECT domain, lang, sum(cap)::BIGINT AS cap, {_cases('lang', LANG_WEIGHTS)} AS weight, any_value(got) AS budget FROM leaves JOIN a USING (domain) GROUP BY domain, lang", "domain")}),
    c AS ({_fill_sql("SELECT domain, lang, source, cap, 1 AS weight, got AS budget FROM leaves JOIN b USING (domain, lang)", "domain, lang")}),
    plan AS (SELECT domain, lang, source, got // tokens AS epochs, got % tokens AS rest FROM leaves JOIN c USING (domain, lang, source)),
    placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}|' || epochs || '|' || coalesce(doc_id::VARCHAR, ''))) AS stop FROM docs JOIN plan USING (domain, lang, source) WHERE tokens > 0)
    SELECT doc_id, domain, lang, source, tokens, (epochs + CASE WHEN stop <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM placed WHERE epochs + CASE WHEN stop <= rest THEN 1 ELSE 0 END > 0"""
