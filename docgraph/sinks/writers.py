"""Writers. All are idempotent by key, so that a task that Spark tries again does no harm."""

from __future__ import annotations

import json
import mimetypes
import pickle
import re
import sqlite3
import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.functions.text import MAGIC


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row's text or bytes to its own file under a shared folder; (name, bytes) of what was written."""
    import pathlib

    import pandas as pd

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        base = pathlib.Path(folder)
        base.mkdir(parents=True, exist_ok=True)
        for pdf in batches:
            rows = []
            for n, c in zip(pdf["n"], pdf["c"], strict=True):
                data = c.encode() if isinstance(c, str) else bytes(c)
                to = (base / n).resolve()
                if base.resolve() not in to.parents:
                    raise ValueError(f"{n} is outside the folder")
                part = to.with_name(to.name + ".part")
                part.write_bytes(data)
                part.replace(to)
                rows.append((n, len(data)))
            yield pd.DataFrame(rows, columns=["name", "bytes"])

    return df.where(F.col(content).isNotNull()).select(F.col(name).alias("n"), F.col(content).alias("c")).mapInPandas(run, "name string, bytes bigint")


def retry(call: Callable[[], Any], attempts: int = 3, wait: float = 1.0, factor: float = 2.0) -> Any:
    """The call's result; failures but the last are waited out, ever longer."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 == attempts:
                raise
            time.sleep(wait * factor**k)
    return None


def foreach_batch(df: DataFrame, write: Callable[[list[dict[str, Any]]], None], size: int = 1000, attempts: int = 3, wait: float = 1.0) -> None:
    """Hands rows to any store's bulk call, in batches, from the executors; each batch is retried, empty ones skipped."""

    def run(rows: Iterable[Any]) -> None:
        batch: list[dict[str, Any]] = []
        for r in rows:
            batch.append(r.asDict(recursive=True))
            if len(batch) >= size:
                retry(lambda b=batch: write(b), attempts, wait)
                batch = []
        if batch:
            retry(lambda: write(batch), attempts, wait)

    df.foreachPartition(run)


def upsert_statement(table: str, columns: list[str], keys: list[str]) -> str:
    """INSERT ... ON CONFLICT of PostgreSQL and SQLite, with named places."""
    q = lambda c: '"' + c.replace('"', '""') + '"'
    rest = [c for c in columns if c not in keys]
    then = f"DO UPDATE SET {', '.join(f'{q(c)} = excluded.{q(c)}' for c in rest)}" if rest else "DO NOTHING"
    return f"INSERT INTO {q(table)} ({', '.join(map(q, columns))}) VALUES ({', '.join('?' for _ in columns)}) ON CONFLICT ({', '.join(map(q, keys))}) {then}"


def sqlite_upsert(df: DataFrame, path: str, table: str, keys: list[str] | None = None) -> None:
    """Upserts rows by key; lists and structs become JSON. The file must be shared by the executors."""
    columns, keys = df.columns, keys or ["id"]
    statement = upsert_statement(table, columns, keys)

    def write(rows: list[dict[str, Any]]) -> None:
        with sqlite3.connect(path, timeout=60) as db:
            db.executemany(statement, [tuple(json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (dict, list)) else v for v in (r[c] for c in columns)) for r in rows])

    foreach_batch(df, write)


def _by_name(rows: list[dict[str, Any]], column: str) -> dict[str, list[dict[str, Any]]]:
    by: dict[str, list[dict[str, Any]]] = {}
    for r in rows:
        by.setdefault(str(r[column]).replace("`", "_").replace(":", "_"), []).append(r)
    return by


def neo4j_batches(nodes: DataFrame, run: Callable[[str, list[dict[str, Any]]], None], edges: DataFrame | None = None) -> None:
    """UNWIND and MERGE per label, then per type of relation; ``run`` takes (statement, rows).

    Batches are spread by the row's own key and grouped within each, so that one label or type, however common, is
    nobody's alone. Ends of relations that are no nodes yet are made.
    """

    def write_nodes(rows: list[dict[str, Any]]) -> None:
        for label, some in _by_name(rows, "node_class").items():
            run(f"UNWIND $rows AS row MERGE (n:`{label}` {{id: row.node_id}}) SET n += row", some)

    def write_edges(rows: list[dict[str, Any]]) -> None:
        for kind, some in _by_name(rows, "type").items():
            run(f"UNWIND $rows AS row MERGE (a {{id: row.source}}) MERGE (b {{id: row.target}}) MERGE (a)-[r:`{kind}`]->(b) SET r += row", some)

    foreach_batch(nodes.repartition("node_id"), write_nodes)
    if edges is not None:
        foreach_batch(edges.repartition("source", "target"), write_edges)


def encoded(value: Any, extension: str | None = None, mime: str | None = None) -> tuple[bytes, str]:
    """(bytes, extension) of a value as a file: bytes and texts as they are, lists and objects as JSON, else pickled.

    The extension is the one given, else the MIME type's, else what the first bytes or the kind of value say.
    """
    if isinstance(value, (bytes, bytearray)):
        data = bytes(value)
        guess = next((e for m, e in MAGIC.items() if data[:8].hex().upper().startswith(m)), ".bin")
    elif isinstance(value, str):
        data, guess = value.encode(), ".html" if re.match(r"(?is)\s*<(!doctype html|html)", value) else ".txt"
    else:
        try:
            data, guess = json.dumps(value, ensure_ascii=False).encode(), ".json"
        except (TypeError, ValueError):
            data, guess = pickle.dumps(value), ".pkl"
    return data, extension or (mimetypes.guess_extension(mime.split(";")[0].strip()) if mime else None) or guess


def console(df: DataFrame, rows: int = 20) -> None:
    """Prints the first rows."""
    df.show(rows, truncate=80)


def sanitize(df: DataFrame) -> DataFrame:
    """Scalars and lists of scalars stay; whatever nests becomes JSON."""
    deep = (T.StructType, T.MapType)

    def nests(t: T.DataType) -> bool:
        return isinstance(t, deep) or (isinstance(t, T.ArrayType) and isinstance(t.elementType, (*deep, T.ArrayType)))

    return df.withColumns({f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema if nests(f.dataType)})


def property_map(columns: list[str]) -> Column:
    """A map of texts without the nulls, as vector stores want their metadata."""
    return F.map_filter(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())


def warehouse_rows(nodes: DataFrame, limit: int = 20_000) -> DataFrame:
    """The six columns of the warehouse table; the schema text is cut."""
    text = F.to_json(F.struct(*[F.col(c) for c in nodes.columns]))
    return nodes.select("node_id", "node_class", F.coalesce("content", F.lit("")).alias("content"), F.length("content").alias("n_chars"), F.md5("content").alias("checksum"), F.substring(text, 1, limit).alias("schema_text"))


def vectors_complete(df: DataFrame, vector: str = "vector") -> bool:
    """Whether every row has a vector: only then may a store take them."""
    return bool(df.agg(F.coalesce(F.bool_and(F.col(vector).isNotNull()), F.lit(False))).first()[0])
