"""Sinks: CSV with fixed columns, ledger, graph exchange format, drawings and counters."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.sources.tables import LEDGER, assert_columns


def write_csv(df: DataFrame, path: str, columns: Iterable[str] | None = None, single: bool = False) -> None:
    """B1, B2: the given columns in their order; other columns are left out and missing ones are an error."""
    columns = list(columns or df.columns)
    out = assert_columns(df, columns, path).select(*[F.col(f"`{c}`") for c in columns])
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _store(df: DataFrame, path: str):
    """The file system of a path and the maker of its paths."""
    path_of = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), path_of


def replace_csv(df: DataFrame, path: str) -> None:
    """Write beside the path, put the old table aside, swap, and only then delete the old one.

    ``df`` may be read from the path. At any moment one of the two is whole.
    """
    beside, aside = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write_csv(df, beside)
    fs, path_of = _store(df, path)
    if fs.exists(path_of(path)) and not fs.rename(path_of(path), path_of(aside)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(path_of(beside), path_of(path)):
        fs.rename(path_of(aside), path_of(path))
        raise OSError(f"cannot move {beside} to {path}")
    fs.delete(path_of(aside), True)


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """The column ``line`` as one text file, in the order of other columns."""
    beside = f"{path}.new-{uuid.uuid4().hex}"
    lines.coalesce(1).sortWithinPartitions(*order).select("line").write.text(beside)
    fs, path_of = _store(lines, path)
    part = next(p for p in (s.getPath() for s in fs.listStatus(path_of(beside))) if p.getName().startswith("part-"))
    fs.delete(path_of(path), True)
    if not fs.rename(part, path_of(path)):
        raise OSError(f"cannot move {part} to {path}")
    fs.delete(path_of(beside), True)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Sorted by verdict and names."""
    write_csv(ledger.select(*LEDGER).orderBy("verdict", "name_a", "name_b").coalesce(1), path)


def write_candidates(diff: DataFrame, path: str, columns: Iterable[str]) -> bool:
    """An edition diff, if it has a row; declared columns first."""
    columns = list(columns)
    if not diff.limit(1).count():
        return False
    write_csv(diff, path, [*columns, *(c for c in diff.columns if c not in columns)])
    return True


def _escaped(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


#: Fields of a node of the graph file, and which of them are numbers.
NODE_FIELDS = ["bipartite", "book", "author", "first_year", "last_year", "label", "normalized_name"]
NODE_NUMBERS = ["bipartite", "first_year", "last_year"]


def graphml_lines(works: DataFrame, persons: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (part, line) of the bipartite graph in GraphML; parts are head, works, persons, edges and tail."""
    spark = works.sparkSession
    keys = [f'<key id="d{k}" for="node" attr.name="{f}" attr.type="{"long" if f in NODE_NUMBERS else "string"}"/>' for k, f in enumerate(NODE_FIELDS)]
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="undirected">']
    frame = spark.createDataFrame([(0, k, line) for k, line in enumerate(head)] + [(4, 0, "</graph>"), (4, 1, "</graphml>")], "part int, place int, line string")
    for part, (nodes, side, key) in enumerate(((works, 0, "book"), (persons, 1, "person_id")), 1):
        values = {f: F.col(f).cast("string") for f in NODE_FIELDS if f in nodes.columns} | {"bipartite": F.lit(str(side))}
        data = [F.when(v.isNotNull(), F.concat(F.lit(f'<data key="d{NODE_FIELDS.index(f)}">'), _escaped(v), F.lit("</data>"))) for f, v in values.items()]
        line = F.concat(F.lit('<node id="'), _escaped(F.col(key)), F.lit('">'), F.concat_ws("", *data), F.lit("</node>"))
        frame = frame.union(nodes.select(F.lit(part), F.lit(0), line))
    line = F.concat(F.lit('<edge source="'), _escaped(F.col("person_id")), F.lit('" target="'), _escaped(F.col("book")), F.lit('"/>'))
    return frame.union(edges.select(F.lit(3), F.lit(0), line))


def write_graphml(works: DataFrame, persons: DataFrame, edges: DataFrame, path: str) -> None:
    """The bipartite graph as one GraphML file."""
    write_lines(graphml_lines(works, persons, edges), path, ["part", "place"])


def ring_svg(ring: DataFrame, chords: DataFrame, size: int = 1000) -> str:
    """A chord drawing from layout tables; as many shapes as there are works and pairs of works."""
    at = {r["book"]: r for r in ring.collect()}
    middle, radius = size / 2, size * 0.38
    spot = {b: (middle + radius * r["x"], middle - radius * r["y"]) for b, r in at.items()}
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}">']
    for c in sorted(chords.collect(), key=lambda r: (r["shared"], r["work_a"], r["work_b"])):
        (xa, ya), (xb, yb) = spot[c["work_a"]], spot[c["work_b"]]
        parts.append(f'<path d="M{xa:.1f} {ya:.1f}Q{middle} {middle} {xb:.1f} {yb:.1f}" fill="none" stroke="#8884" stroke-width="{c["width"]:.2f}"/>')
    for book, row in sorted(at.items()):
        x, y = spot[book]
        parts.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{row["radius"] / 2:.1f}" fill="{row["color"]}"/><text x="{x:.1f}" y="{y:.1f}">{escape(book)}</text>')
    return "\n".join([*parts, "</svg>"])


def counters(df: DataFrame, **conditions: str) -> DataFrame:
    """One row with the number of rows and of those for which each condition holds."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()])
