"""Header to field mapping: exact words first, then greedy best similarity; one Arrow UDF over distinct header lists."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import vocabulary as V
from ledgerloom.functions.cut import cut

#: The maps that classification and routing need: (vocabulary, threshold) by name.
WANTED = {
    "holding_strict": ("holding", V.STRICT),
    "holding": ("holding", V.LOOSE),
    "transaction_strict": ("transaction", V.STRICT),
    "transaction": ("transaction", V.LOOSE),
    "constituent": ("constituent", V.LOOSE),
    "rebalance": ("rebalance", V.LOOSE),
}


@lru_cache(1 << 16)
def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of the lower-case, stripped strings. Not symmetric: the raw header comes first."""
    a, b = a.lower().strip(), b.lower().strip()
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@lru_cache(1 << 14)
def map_columns(headers: tuple[str, ...], vocabulary: str, threshold: float = V.LOOSE) -> dict[str, str]:
    """field -> header, one to one; fields without a header are left out.

    Headers equal to a word of a field take it, the first header first. Then each open field, in vocabulary order, takes
    the most similar free header (of equal ones the first) if it reaches the threshold.
    """
    fields = V.VOCABULARIES[vocabulary]
    owner = {word.lower(): field for field, words in fields.items() for word in words}
    chosen: dict[str, str] = {}
    for header in headers:
        field = owner.get(header.lower().strip())
        if field is not None and field not in chosen:
            chosen[field] = header
    free = [h for h in dict.fromkeys(headers) if h not in chosen.values()]
    for field, words in fields.items():
        if field not in chosen and free:
            best = max(free, key=lambda h: max(similarity(h, w) for w in words))
            if max(similarity(best, w) for w in words) >= threshold:
                chosen[field] = best
                free.remove(best)
    return chosen


def header_points(cell: str) -> int:
    """2 for a word of the holding or transaction vocabulary, 1 for one that resembles it, else 0."""
    c = cell.lower().strip()
    words = known_words()
    if not c:
        return 0
    return 2 if c in words else int(any(SequenceMatcher(None, w, c).ratio() >= V.HEADER_CUTOFF for w in words))


@lru_cache(1)
def known_words() -> frozenset[str]:
    return frozenset(w.lower() for v in (V.HOLDING, V.TRANSACTION) for words in v.values() for w in words)


@F.pandas_udf(T.IntegerType())
def header_points_udf(cells: pd.Series) -> pd.Series:
    return cells.fillna("").map(lru_cache(1 << 16)(header_points))


MAPS = T.StructType([T.StructField(n, T.MapType(T.StringType(), T.StringType())) for n in WANTED])


@F.pandas_udf(MAPS)
def header_maps(headers: pd.Series) -> pd.DataFrame:
    lists = [tuple(h) if h is not None else () for h in headers]
    return pd.DataFrame({n: [map_columns(h, v, t) for h in lists] for n, (v, t) in WANTED.items()})


#: Distinct lists of headers whose maps are broadcast to the tables; more are joined by shuffle.
BROADCAST_LISTS = 50_000


def with_maps(tables: DataFrame) -> DataFrame:
    """tables (headers) -> with maps: each distinct list of headers is matched once; null headers map nothing.

    The maps are written once and counted; while they are few the tables, which may share one layout, do not move.
    """
    maps = cut(tables.select(F.col("headers").alias("m_headers")).distinct().withColumn("maps", header_maps("m_headers")))
    few = maps.limit(BROADCAST_LISTS + 1).count() <= BROADCAST_LISTS
    return tables.join(F.broadcast(maps) if few else maps, tables["headers"].eqNullSafe(F.col("m_headers")), "left").drop("m_headers")


def field_cell(cells: Column, headers: Column, chosen: Column, field: str) -> Column:
    """The cell of a field's header, null without one."""
    place = F.array_position(headers, F.try_element_at(chosen, F.lit(field)))
    return F.when(place > 0, F.get(cells, (place - 1).cast("int")))


def project(rows: DataFrame, chosen: Column, fields: list[str]) -> DataFrame:
    """Late-bound projection: one nullable text column a field, from rows with headers and cells."""
    return rows.withColumns({f: field_cell(F.col("cells"), F.col("headers"), chosen, f) for f in fields})


def ignored(headers: Column, chosen: Column) -> Column:
    """Headers that no field takes."""
    return F.array_except(headers, F.map_values(chosen))
