"""Mixing sources to target weights (7): iterative proportional fitting, in DataFrame operations.

Documents fall into cells (source, lang, topic).  The cells' expected sampled
tokens y are raked: each round scales them so that the sums by source, by
language and by topic meet their targets in turn.  A document of a cell is
sampled with the calibrated probability y / (the cell's tokens).

No cell can give more than its own tokens (`repeats` times those where rows may
be repeated), so that bound is part of the raking: where a value's cells have to
grow, full ones stay full and what they cannot give is spread over the others
in proportion; where they have to shrink, all do.  A target above what its
value has cannot be met at this rate: such values are taken whole, and the rest
of the margin's total goes to its other values (`_filled`).  Where targets of
different margins exclude one another, those of the last margin hold.  `margins` reports wanted, reachable and expected tokens of each value.
Rounds end when the margins are met to TOLERANCE, after ROUNDS at the latest.

By default a target is proportional to the value's own tokens to the power
`alpha` (tempered mixing); explicit shares can be given for any margin.  The
margins' common total is `rate` times all tokens.
Tokens of a text are ceil(UTF-8 bytes / 4).  Topics are the first rule of
TOPICS with a substring that the text has.

A document's draw is a hash of its id and the seed, so a sample repeats and
does not depend on how rows are dealt.  The table of cells is aggregated in the
tasks first, so a hot source costs a few rows; it is broadcast only if it has
at most CELLS rows, and joined by a shuffle otherwise.

Defined cases: null source, lang and topic are cells of their own; a null text
has no tokens; documents without tokens are never sampled; a null id draws by its text;
a target for a value that no document has is ignored; rows stay, with any id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelfactor.llm._spark import cut, documents, masked

ALPHA, RATE, SEED = 0.5, 0.5, "mix-1"
#: rounds at most, between two looks at the residual, and the relative residual that ends them
ROUNDS, STEP, TOLERANCE = 24, 6, 1e-13
#: rows of a table of cells that may be broadcast (about 100 bytes each)
CELLS = 100_000
TOPICS = (("contact", ("@",)), ("licence", ("icense", "opyright")), ("table", (" | ",)), ("code", ("def ", "{", "();")))
MARGINS = ("source", "lang", "topic")


def topic_of(text: Column, rules=TOPICS, other: str = "prose") -> Column:
    out = F.lit(other)
    for name, parts in reversed(rules):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(text, F.lit(p))
        out = F.when(hit, name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def _filled(df: DataFrame, total: str, cap: str, y: str) -> DataFrame:
    """df with y scaled by one factor, and cut at cap, so that its sum is `total`.

    With the first k rows by cap / y full, the factor would be (total - their
    caps) / (the others' y); it is the greatest of these over all k.
    """
    ratio = F.when(F.col(y) > 0, F.col(cap) / F.col(y))
    part = Window.partitionBy(F.lit(0))
    up = part.orderBy(ratio.asc_nulls_last(), "_value").rowsBetween(Window.unboundedPreceding, -1)
    down = part.orderBy(ratio.desc_nulls_first(), F.desc("_value")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_full": F.coalesce(F.sum(cap).over(up), F.lit(0.0)), "_rest": F.sum(y).over(down)})
    df = df.withColumn("_factor", F.max(F.when(F.col("_rest") > 0, (F.col(total) - F.col("_full")) / F.col("_rest"))).over(part))
    return df.withColumn(y, F.coalesce(F.least(F.col(cap), F.col("_factor") * F.col(y)), F.lit(0.0))).drop("_full", "_rest", "_factor")


def _wanted(cells: DataFrame, margin: str, alpha: float, given: dict | None, total: float) -> DataFrame:
    """Rows (_value, own, wanted) of a margin: tokens that its values have and should give."""
    values = cells.groupBy(F.col(margin).alias("_value")).agg(F.sum("x").cast("double").alias("own"))
    share = F.pow("own", F.lit(alpha))
    if given:
        share = F.lit(0.0)
        for value, part in given.items():
            share = F.when(F.col("_value").eqNullSafe(F.lit(value)), float(part)).otherwise(share)
    values = values.withColumn("share", F.when(F.col("own") > 0, share).otherwise(0.0))
    return values.select("_value", "own", F.coalesce(F.lit(total) * F.try_divide(F.col("share"), F.sum("share").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)).alias("wanted"))


def _reachable(cells: DataFrame, margin: str, total: float) -> DataFrame:
    """Rows (_value, target) of a margin: tokens that its values can give."""
    values = cells.groupBy(F.col(margin).alias("_value")).agg(F.sum("cap").alias("cap"), F.first(f"wanted_{margin}").alias("target"))
    return _filled(values.withColumn("_total", F.lit(total)), "_total", "cap", "target").select("_value", "target")


def _raked(source: str, margin: str) -> str:
    """SQL of `source` with y scaled towards the target of the row's value of a margin, and never above cap."""
    part, target = f"OVER (PARTITION BY {margin})", f"target_{margin}"
    sums = f"SELECT *, sum(cap) {part} AS _cap, sum(y) {part} AS _sum, sum(CASE WHEN y >= cap THEN cap ELSE 0 END) {part} AS _full, sum(CASE WHEN y >= cap THEN 0 ELSE y END) {part} AS _rest FROM {source}"
    shrunk, grown = f"y * try_divide({target}, _sum)", f"least(cap, y * try_divide({target} - _full, _rest))"
    y = f"CASE WHEN {target} >= _cap * (1 - 1e-9D) THEN cap WHEN _sum >= {target} THEN {shrunk} WHEN y >= cap THEN cap ELSE {grown} END"
    return f"(SELECT {', '.join(MARGINS)}, x, cap, coalesce({y}, 0D) AS y, {', '.join(f'target_{m}' for m in MARGINS)} FROM ({sums}))"


def fit(cells: DataFrame, alpha: float = ALPHA, rate: float = RATE, targets: dict[str, dict] | None = None, rounds: int = ROUNDS, repeats: int = 1) -> DataFrame:
    """cells (source, lang, topic, x) with y, their expected sampled tokens, and own_, wanted_ and target_ of each margin."""
    few = cells.count() <= CELLS
    total = float(rate) * float(cells.agg(F.sum("x")).first()[0] or 0)

    def with_values(cells: DataFrame, values: DataFrame, m: str) -> DataFrame:
        values = values.toDF(*(c if c == "_value" else f"{c}_{m}" for c in values.columns))
        return cells.join(F.broadcast(values) if few else values, F.col(m).eqNullSafe(F.col("_value")), "left").drop("_value")

    for m in MARGINS:
        cells = with_values(cells, _wanted(cells, m, alpha, (targets or {}).get(m), total), m)
    # a cell with a value of which nothing is wanted gives nothing
    none = F.least(*(F.col(f"wanted_{m}") for m in MARGINS)) <= 0
    cells = cut(cells.withColumn("cap", F.when(none, 0.0).otherwise(F.col("x").cast("double") * repeats)))
    for m in MARGINS:
        cells = with_values(cells, _reachable(cells, m, total), m)
    cells = cut(cells.withColumn("y", F.least(F.col("cap"), F.col("x") * F.lit(float(rate)))))
    facts = [c for c in cells.columns if c.startswith(("own_", "wanted_"))]
    about, state = cells.select(*MARGINS, *facts), cells.drop(*facts)
    for done in range(0, rounds, STEP):
        text = "{state}"
        for k in range(min(STEP, rounds - done) * len(MARGINS)):
            text = _raked(text, MARGINS[k % len(MARGINS)])
        if few:
            state = state.coalesce(1)  # a bounded table: no shuffle for each margin
        state = cut(state.sparkSession.sql(f"SELECT * FROM {text}", state=state))
        if residual(state) <= TOLERANCE:
            break
    state = state.drop("cap").toDF(*(f"_{c}" if c in MARGINS else c for c in state.columns if c != "cap"))
    about = F.broadcast(about) if few else about
    on = [F.col(f"_{m}").eqNullSafe(F.col(m)) for m in MARGINS]
    return state.join(about, on).select(*MARGINS, "x", "y", *facts, *(f"target_{m}" for m in MARGINS))


def _report(cells: DataFrame) -> DataFrame:
    """Rows (margin, value, tokens, wanted, target, expected) from what `fit` gives."""
    parts = [cells.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.sum("x").alias("tokens"), F.first(f"wanted_{m}").alias("wanted"), F.first(f"target_{m}").alias("target"), F.sum("y").alias("expected")) for m in MARGINS]
    return parts[0].union(parts[1]).union(parts[2])


def residual(cells: DataFrame) -> float:
    """The greatest relative distance of a margin's expected tokens from its target."""
    each = [cells.groupBy(F.col(m).alias("value")).agg(F.first(f"target_{m}").alias("t"), F.sum("y").alias("y")) for m in MARGINS]
    return each[0].union(each[1]).union(each[2]).agg(F.max(F.try_divide(F.abs(F.col("y") - F.col("t")), F.col("t")))).first()[0] or 0.0


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> tuple[DataFrame, DataFrame, str, str]:
    """docs with masked names and source, lang, topic and tokens; the cells; and the masked names of id and text."""
    plain, (own_id, text, source, lang) = masked(docs, id_col, text_col, source_col, lang_col)
    topic = F.col(f"c{docs.columns.index(topic_col)}").cast("string") if topic_col else topic_of(F.coalesce(text, F.lit("")))
    rows = plain.withColumns({"source": F.col(source).cast("string"), "lang": F.col(lang).cast("string"), "topic": topic, "tokens": tokens_of(F.col(text))})
    return rows, cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("x"))), own_id, text


def margins(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, **options) -> DataFrame:
    """Rows (margin, value, tokens, wanted, target, expected): what each value has, should give, can give and is expected to give."""
    return _report(fit(_rows(docs, id_col, text_col, source_col, lang_col, topic_col)[1], **options))


def weigh(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, seed: str = SEED, **options) -> DataFrame:
    """docs with _source, _lang, _topic, _tokens, _probability, _sampled, _expected and _copies (both above 1 only where `repeats` is)."""
    rows, cells, own_id, text = _rows(docs, id_col, text_col, source_col, lang_col, topic_col)
    chance = fit(cells, **options).select(*(F.col(m).alias(f"of_{m}") for m in MARGINS), F.coalesce(F.try_divide(F.col("y"), F.col("x")), F.lit(0.0)).alias("expected"))
    chance = chance.withColumn("probability", F.least(F.lit(1.0), "expected"))
    if cells.count() <= CELLS:
        chance = F.broadcast(chance)
    on = [F.col(m).eqNullSafe(F.col(f"of_{m}")) for m in MARGINS]
    joined = rows.join(chance, on, "left")
    key = F.coalesce(F.col(own_id).cast("string"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("double") / float(1 << 48)
    whole = F.floor("expected")
    copies = whole + F.when(draw < F.col("expected") - whole, 1).otherwise(0)
    out = joined.withColumns({"sampled": draw < F.col("probability"), "copies": copies.cast("long")})
    own = ("source", "lang", "topic", "tokens", "probability", "sampled", "expected", "copies")
    return out.select(*(f"c{k}" for k in range(len(docs.columns))), *own).toDF(*docs.columns, *(f"_{c}" for c in own))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weigh(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs, each as often as its copies, with docs' columns."""
    out = weigh(docs, **options).where("_copies > 0")
    plain = out.toDF(*(f"c{k}" for k in range(len(out.columns))))
    again = plain.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col(plain.columns[-1]))))
    return again.select(*plain.columns[: len(docs.columns)]).toDF(*docs.columns)


def sql(table: str = "documents", rounds: int = ROUNDS, alpha: float = ALPHA, rate: float = RATE, seed: str = SEED) -> tuple[str, str]:
    """DuckDB SQL of the same: the common table expressions, and the name of the one with the result."""
    case = " ".join("WHEN " + " OR ".join(f"contains(coalesce(text, ''), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in TOPICS)

    def filled(source: str, key: str) -> str:
        ratio = "CASE WHEN target > 0 THEN cap / target END"
        sums = f"SELECT *, coalesce(sum(cap) OVER (ORDER BY {ratio} ASC NULLS LAST, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f_full, sum(target) OVER (ORDER BY {ratio} DESC NULLS FIRST, {key} DESC ROWS UNBOUNDED PRECEDING) AS f_rest FROM {source}"
        return f"SELECT {key}, coalesce(least(cap, f_factor * target), 0) AS target FROM (SELECT *, max(CASE WHEN f_rest > 0 THEN (total - f_full) / f_rest END) OVER () AS f_factor FROM ({sums}))"

    def raked(source: str, m: str) -> str:
        part = f"OVER (PARTITION BY {m})"
        sums = f"SELECT *, sum(x) {part} AS f_cap, sum(y) {part} AS f_sum, sum(CASE WHEN y >= x THEN x ELSE 0 END) {part} AS f_full, sum(CASE WHEN y >= x THEN 0 ELSE y END) {part} AS f_rest FROM {source}"
        y = f"coalesce(CASE WHEN target_{m} >= f_cap * (1 - 1e-9) THEN x WHEN f_sum >= target_{m} THEN y * (target_{m} / nullif(f_sum, 0)) WHEN y >= x THEN x ELSE least(x, y * ((target_{m} - f_full) / nullif(f_rest, 0))) END, 0)"
        return f"SELECT * EXCLUDE (f_cap, f_sum, f_full, f_rest) REPLACE ({y} AS y) FROM ({sums})"

    steps = [
        f"mix_rows AS (SELECT *, CASE {case} ELSE 'prose' END AS m_topic, coalesce(CAST(ceil(strlen(text) / 4.0) AS BIGINT), 0) AS m_tokens FROM {table})",
        "mix_cells AS (SELECT source, lang, m_topic AS topic, CAST(sum(m_tokens) AS DOUBLE) AS x FROM mix_rows GROUP BY ALL)",
        f"mix_total AS (SELECT {rate} * sum(x) AS total FROM mix_cells)",
    ]
    for m in MARGINS:
        steps.append(f"mix_v_{m} AS (SELECT {m}, sum(x) AS cap, CASE WHEN sum(x) > 0 THEN pow(sum(x), {alpha}) ELSE 0 END AS share FROM mix_cells GROUP BY {m})")
        steps.append(f"mix_w_{m} AS (SELECT {m}, cap, total, coalesce(total * share / nullif(sum(share) OVER (), 0), 0) AS target FROM mix_v_{m}, mix_total)")
        steps.append(f"mix_t_{m} AS MATERIALIZED ({filled(f'mix_w_{m}', m)})")
    joins = " ".join(f"LEFT JOIN mix_t_{m} AS t_{m} ON c.{m} IS NOT DISTINCT FROM t_{m}.{m}" for m in MARGINS)
    steps.append(f"mix_0 AS MATERIALIZED (SELECT c.*, c.x * {rate} AS y, {', '.join(f't_{m}.target AS target_{m}' for m in MARGINS)} FROM mix_cells c {joins})")
    for n in range(rounds * len(MARGINS)):
        m = MARGINS[n % len(MARGINS)]
        steps.append(f"mix_{n + 1} AS MATERIALIZED ({raked(f'mix_{n}', m)})")
    steps.append(
        f"mix_out AS (SELECT r.*, least(1.0, coalesce(c.y / nullif(c.x, 0), 0)) AS m_probability, CAST(CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12)) AS BIGINT) AS DOUBLE) / {float(1 << 48)} AS m_draw"
        f" FROM mix_rows r JOIN mix_{rounds * len(MARGINS)} c ON r.source IS NOT DISTINCT FROM c.source AND r.lang IS NOT DISTINCT FROM c.lang AND r.m_topic = c.topic)"
    )
    return ", ".join(steps), "mix_out"


SQL = "WITH {} SELECT doc_id, m_topic AS topic, m_tokens AS tokens, round(m_probability, 6) AS probability, m_draw < m_probability AS sampled FROM {}".format(*sql())
