"""Time series, relational reports and retrieval."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.functions.text import col
from docgraph.operators.lineage import free_name


def _rolling(keys: list[str], order: list[str], n: int) -> Any:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)


def difference(df: DataFrame, value: str, keys: list[str], order: list[str], name: str = "diff") -> DataFrame:
    """First differences along each series; the first row's is null."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def rsi(df: DataFrame, value: str, keys: list[str], order: list[str], n: int = 14, name: str = "rsi") -> DataFrame:
    """Relative strength by plain means of the last ``n`` gains and losses; the first row gains and loses 0.

    100 where nothing was lost but something gained, null where nothing moved or the window is not full.
    """
    w = _rolling(keys, order, n)
    d = difference(df, value, keys, order, "__d").withColumns({"__g": F.when(F.col("__d") > 0, F.col("__d")).otherwise(0.0), "__l": F.when(F.col("__d") < 0, -F.col("__d")).otherwise(0.0)})
    gain, loss = F.avg("__g").over(w), F.avg("__l").over(w)
    out = F.when(loss == 0, F.when(gain > 0, 100.0)).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return d.withColumn(name, F.when(F.count(F.lit(1)).over(w) == n, out)).drop("__d", "__g", "__l")


def moving_averages(df: DataFrame, value: str, keys: list[str], order: list[str], sizes: tuple[int, ...] = (5, 20, 60), prefix: str = "sma") -> DataFrame:
    """A mean over each number of rows, null until the window is full."""
    out = {}
    for n in sizes:
        w = _rolling(keys, order, n)
        out[f"{prefix}{n}"] = F.when(F.count(value).over(w) == n, F.avg(value).over(w))
    return df.withColumns(out)


def bollinger(df: DataFrame, value: str, keys: list[str], order: list[str], n: int = 20, width: float = 2.0) -> DataFrame:
    """Rolling mean, and bands at ``width`` sample deviations."""
    w = _rolling(keys, order, n)
    full, mid, dev = F.count(value).over(w) == n, F.avg(value).over(w), F.stddev_samp(value).over(w)
    return df.withColumns({"bb_mid": F.when(full, mid), "bb_upper": F.when(full, mid + width * dev), "bb_lower": F.when(full, mid - width * dev)})


def macd(df: DataFrame, value: str, keys: list[str], order: list[str], fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(keys, order, macd, signal, hist): exponential means are a fold in order, so each series is one Arrow-batched group."""
    import pandas as pd

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*keys, *order]) + ", macd double, macd_signal double, macd_hist double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        line = pdf[value].ewm(span=fast, adjust=False).mean() - pdf[value].ewm(span=slow, adjust=False).mean()
        sig = line.ewm(span=signal, adjust=False).mean()
        return pdf[[*keys, *order]].assign(macd=line, macd_signal=sig, macd_hist=line - sig)

    return df.select(*keys, *order, F.col(value).cast("double").alias(value)).groupBy(*keys).applyInPandas(run, schema)


def screen(df: DataFrame, keys: list[str], order: list[str], value: str = "rsi", low: float = 30, high: float = 70) -> DataFrame:
    """Each series' last row with a signal: BUY under ``low``, SELL over ``high``, else HOLD."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    n = free_name(df, "__n")
    latest = df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)
    return latest.withColumn("signal", F.when(F.col(value) < low, "BUY").when(F.col(value) > high, "SELL").otherwise("HOLD"))


def score_card(df: DataFrame, value: str, volume: str, keys: list[str], order: list[str]) -> DataFrame:
    """Nine conditions over a series of prices; a row's score is how many hold, its grade A, B, C or D at 7, 5 and 3.

    Basic: rsi under 30; price over its 20-row mean; 5-row mean over the 20-row mean; volume over its 20-row mean.
    Advanced: price under the lower band; rsi rising; rsi rising twice; the price up; the 5-row mean just crossed up.
    """
    out = bollinger(moving_averages(rsi(df, value, keys, order), value, keys, order, (5, 20)), value, keys, order)
    out = moving_averages(out, volume, keys, order, (20,), "vol_ma")
    w = Window.partitionBy(*keys).orderBy(*order)
    names = {(x, n): free_name(out, f"__{x}_{n}") for x in ("rsi", "sma5", "sma20", value) for n in (1, 2)}
    out = out.withColumns({name: F.lag(x, n).over(w) for (x, n), name in names.items()})
    c, was = F.col, lambda x, n=1: F.col(names[x, n])
    tests = [
        c("rsi") < 30, c(value) > c("sma20"), c("sma5") > c("sma20"), c(volume) > c("vol_ma20"), c(value) < c("bb_lower"), c("rsi") > was("rsi"),
        (c("rsi") > was("rsi")) & (was("rsi") > was("rsi", 2)), c(value) > was(value), (c("sma5") > c("sma20")) & (was("sma5") <= was("sma20")),
    ]
    score = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    return out.withColumn("score", score).withColumn("grade", F.when(c("score") >= 7, "A").when(c("score") >= 5, "B").when(c("score") >= 3, "C").otherwise("D")).drop(*names.values())


def split_by(df: DataFrame, column: str, values: list[Any]) -> dict[Any, DataFrame]:
    """The rows of each value; rows of another value, or none, are in no part."""
    return {v: df.where(F.col(column) == F.lit(v)) for v in values}


def concat(parts: dict[Any, DataFrame], label: str) -> DataFrame:
    """The parts under one another, each with its name; columns that a part lacks are null."""
    out = None
    for name, df in parts.items():
        named = df.withColumn(label, F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def sorted_rows(df: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """The rows by columns, each ascending (true) or descending, nulls last; a range shuffle, and a sort in each range."""
    return df.orderBy(*[F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in order])


def with_events(series: DataFrame, events: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """The series with events' values of the same key, 0 where there is none."""
    out = series.join(events.select(*on, *values), on, "left")
    return out.withColumns({v: F.coalesce(v, F.lit(0)) for v in values})


def split_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    return F.try_divide(col(numerator), col(denominator))


def coerce_prices(df: DataFrame, epoch: str, prices: list[str], volume: str) -> DataFrame:
    """Epoch seconds to a date, prices to 4 decimals, volume to a whole number; what can't be read becomes null."""
    out = {"date": F.to_date(F.timestamp_seconds(F.expr(f"try_cast(`{epoch}` AS BIGINT)")))}
    out |= {p: F.round(F.expr(f"try_cast(`{p}` AS DOUBLE)"), 4) for p in prices}
    return df.withColumns(out | {volume: F.expr(f"try_cast(try_cast(`{volume}` AS DOUBLE) AS BIGINT)")})


def non_zero(df: DataFrame, value: str) -> DataFrame:
    return df.where((F.col(value) != 0) & F.col(value).isNotNull())


def change_percent(new: Column, old: Column) -> Column:
    """Per cent from old to new; 0 where old is 0 or absent."""
    return F.when(old.isNull() | (old == 0), 0.0).otherwise(F.try_divide(new - old, F.abs(old)) * 100)


def latest_change(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Each series' last value against the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    n = free_name(df, "__n")
    out = df.withColumns({"previous": F.lag(value).over(w), n: F.row_number().over(last)}).where(F.col(n) == 1).drop(n)
    return out.withColumn("change_pct", change_percent(F.col(value), F.col("previous")))


def to_wide(df: DataFrame, keys: list[str], column: str, value: str, columns: list[Any], order: str) -> DataFrame:
    """A column for each of ``columns``, the first value by ``order``; the given order of columns holds."""
    return df.groupBy(*keys).pivot(column, columns).agg(F.min_by(value, order))


def statement_pivot(df: DataFrame, account: str, period: str, amount: str, cumulative: str, order: str, periods: list[str], unit: float = 1e8) -> DataFrame:
    """Accounts by period, and by cumulative period marked (+); the last written wins; amounts in ``unit`` with commas."""
    one = df.select(account, F.col(period).alias("p"), F.col(amount).alias("v"), order)
    two = df.select(account, F.concat(F.col(period), F.lit("(+)")).alias("p"), F.col(cumulative).alias("v"), order).where("v IS NOT NULL")
    columns = [x for p in periods for x in (p, f"{p}(+)")]
    return one.unionByName(two).groupBy(account).pivot("p", columns).agg(F.format_number(F.max_by("v", order) / unit, 0))


def parse_number(c: Column | str) -> Column:
    """A number with commas; a dash or nothing is null."""
    s = F.replace(F.trim(col(c)), F.lit(","), F.lit(""))
    return F.when(s.isin("-", ""), None).otherwise(s.try_cast("double"))


def transpose(df: DataFrame, key: str, columns: list[str], rows: list[str]) -> DataFrame:
    """Columns become rows and the rows named in ``rows`` columns."""
    long = df.select(key, *[F.col(c).cast("string") for c in columns]).unpivot([key], columns, "name", "value")
    return long.groupBy("name").pivot(key, rows).agg(F.first("value"))


def top_share(df: DataFrame, value: str, tie: str, k: int = 10) -> DataFrame:
    """The ``k`` largest with their share of the total of all rows, in per cent.

    The total is an aggregate joined back, never a window over one partition.
    """
    total = df.agg(F.sum(value).alias("__total"))
    top = df.orderBy(F.desc(value), tie).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), tie)))
    return ranked.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col(value), F.col("__total")) * 100).drop("__total")


def compare_periods(new: DataFrame, old: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, new_value, old_value, status, change, change_pct): NEW, CLOSED, INCREASED, DECREASED or SAME by one full join."""
    n, o = new.select(*keys, F.col(value).alias("new_value")), old.select(*keys, F.col(value).alias("old_value"))
    a, b = F.col("new_value"), F.col("old_value")
    out = n.join(o, keys, "full_outer")
    status = F.when(b.isNull(), "NEW").when(a.isNull(), "CLOSED").when(a > b, "INCREASED").when(a < b, "DECREASED").otherwise("SAME")
    return out.withColumns({"status": status, "change": F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)), "change_pct": F.when(a.isNotNull() & b.isNotNull(), change_percent(a, b))})


def top_movers(compared: DataFrame, tie: str, k: int = 20) -> DataFrame:
    """The ``k`` rows of either direction that changed most in per cent."""
    up = compared.where("status = 'INCREASED'").orderBy(F.desc("change_pct"), tie).limit(k)
    down = compared.where("status = 'DECREASED'").orderBy("change_pct", tie).limit(k)
    return up.unionByName(down)


def growth(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Per cent from each row to the next of its series."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("yoy_pct", F.when(before.isNotNull() & (before != 0), F.try_divide(F.col(value) - before, F.abs(before)) * 100))


def chosen_or_first(df: DataFrame, keys: list[str], match: Column, value: str, order: str) -> DataFrame:
    """Per key the value of the first row that matches, else of the first row; sorted by it, largest first."""
    out = df.groupBy(*keys).agg(F.coalesce(F.min_by(value, F.when(match, F.col(order))), F.min_by(value, order)).alias(value))
    return out.orderBy(F.desc(value), *keys)


def price_history(pages: DataFrame, start: str, max_page: int) -> DataFrame:
    """Rows of paged prices up to ``max_page`` from ``start`` on: (date, close, volume), dates that can't be read drop out."""
    out = pages.where(F.col("page") <= max_page).select(F.try_to_date("date", "yyyy.MM.dd").alias("date"), parse_number("close").alias("close"), parse_number("volume").cast("bigint").alias("volume"))
    return out.where(F.col("date").isNotNull() & (F.col("date") >= F.lit(start).cast("date")))


def recent(df: DataFrame, ts: str, reference: str, days: int) -> DataFrame:
    """Rows of the ``days`` before ``reference``."""
    ref = F.lit(reference).cast("timestamp_ntz")
    return df.where((F.col(ts) >= ref - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= ref))


def lookup(df: DataFrame, column: str, pattern: str, tie: str, limit: int = 10) -> DataFrame:
    """Rows whose text has the pattern, in any case; the first ``limit``."""
    return df.where(F.col(column).rlike(f"(?i){pattern}")).orderBy(column, tie).limit(limit)


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))


def nearest(df: DataFrame, vector: list[float], k: int = 5, features: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, score, rank): the ``k`` nearest, score 1 less the distance, ties by id; a scan and a top-k, no shuffle."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = df.where(F.col(features).isNotNull()).select(id_col, F.round(1 - l2(F.col(features), q), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def nearest_batch(df: DataFrame, queries: DataFrame, k: int = 5, features: str = "embedding", id_col: str = "vec_id", block: int = 20_000, itself: bool = True, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank) for every query; rows with the query's own id count only if ``itself`` is set.

    Scores are rounded to six digits, and then to ``digits`` if these are fewer; ranks go by what is left, ties by id.

    A batch of rows is scored against some queries at once in numpy, in the task that holds it, at most a million pairs at a
    time, and only its k best for each query leave: what is shuffled is queries x k x tasks. Queries are broadcast in blocks
    of at most ``block``, each a scan of ``df``.
    """
    found = None
    held: list[Any] = []
    for row in queries.where(F.col(features).isNotNull()).select(id_col, features).toLocalIterator():
        held.append(row)
        if len(held) == block:
            part = _nearest_block(df, held, k, features, id_col, itself, digits)
            found, held = part if found is None else found.unionByName(part), []
    if held or found is None:
        part = _nearest_block(df, held, k, features, id_col, itself, digits)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Pairs of a row and a query that a Python worker scores at a time.
PAIRS = 1 << 20


def _nearest_block(df: DataFrame, rows: list[Any], k: int, features: str, id_col: str, itself: bool, digits: int) -> DataFrame:
    import numpy as np
    import pandas as pd

    sent = df.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64)))
    kind = df.schema[id_col].dataType.simpleString()

    def to_digits(x: Any, n: int) -> Any:
        # half away from zero on the scaled number, as SQL has it
        scaled = x * 10.0**n
        whole = np.trunc(scaled)
        return (whole + np.sign(scaled) * (np.abs(scaled - whole) >= 0.5)) / 10.0**n

    def run(batches: Any) -> Any:
        ids, q = sent.value
        best: dict[int, list[tuple[float, Any]]] = {}
        for pdf in batches:
            if not len(ids) or not len(pdf):
                continue
            x = np.stack(pdf[features].to_numpy()).astype(np.float64)
            own = pdf[id_col].to_numpy()
            norms = (x**2).sum(1)[:, None]
            step = max(1, PAIRS // len(x))
            for at in range(0, len(ids), step):
                part = q[at : at + step]
                squares = norms + (part**2).sum(1)
                # what the product's errors and the rounding can move a score
                margin = 1.1 * (10.0**-digits + 1e-6) + 2 * np.sqrt(4 * x.shape[1] * np.finfo(float).eps * squares.max(axis=0))
                squares -= 2 * x @ part.T
                rough = 1 - np.sqrt(np.maximum(0, squares, out=squares), out=squares)
                for j in range(at, at + len(part)):
                    s = rough[:, j - at] if itself else np.where(own == ids[j], -np.inf, rough[:, j - at])
                    cut = np.partition(s, -k)[-k] - margin[j - at] if len(s) > k else -np.inf
                    near = np.flatnonzero((s >= cut) & (s > -np.inf))
                    exact = to_digits(1 - np.sqrt(np.cumsum((x[near] - q[j]) ** 2, axis=1)[:, -1]), 6)
                    if digits < 6:
                        exact = to_digits(exact, digits)
                    best[j] = sorted(best.get(j, []) + list(zip((-exact).tolist(), own[near], strict=True)))[:k]
        yield pd.DataFrame([(ids[j], i, -s) for j, found in best.items() for s, i in found], columns=["query_id", id_col, "score"])

    return df.where(F.col(features).isNotNull()).select(id_col, features).mapInPandas(run, f"query_id {kind}, {id_col} {kind}, score double")


def sql(spark: SparkSession, statement: str, views: dict[str, DataFrame] | None = None, **args: Any) -> DataFrame:
    """A statement with named parameters over the given views."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement, args=args)


def rag_prompt(contexts: DataFrame, query: str, text: str = "content", order: list[str] | None = None) -> DataFrame:
    """(prompt): the contexts in order, then the question. For the top few that retrieval kept."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*(order or ["rank"]), text))), lambda x: x[text]), "\n\n")
    return contexts.agg(F.concat(F.lit("Context:\n"), joined, F.lit(f"\n\nQuestion: {query}\nAnswer:")).alias("prompt"))


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``existing`` with the last change of each key over it; null fields of a change overwrite too."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    n = free_name(changes, "__n")
    last = changes.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n, order)
    kept = existing.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last)
