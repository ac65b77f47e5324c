"""Metrics layer (M1-M7): logical tables, relationships, facts, dimensions, metrics, synonyms.

A :class:`SemanticModel` turns ``query(metrics, dimensions, where, order_by, limit)`` into one
DataFrame plan. Expressions are Spark SQL expression strings, resolved by Spark itself.

Grain rules (why results never fan out):

* every relationship is many-to-one (``to`` columns are the target's primary key), so joining a fact
  table to the dimension tables on its path keeps exactly one row per fact row;
* metrics are aggregated per base table first, at the requested dimensions, and only the aggregates
  are combined across base tables (drill-across, J4): stacked and grouped once on the dimensions,
  which equals a null-safe full outer join of the parts;
* a dimension that is not reachable from a metric's base table by many-to-one steps is rejected.

At scale each base table is scanned once with only the columns its facts, dimensions and filters
use; dimension tables are small and AQE turns their joins into broadcasts at run time after measuring
them, while fact-to-fact steps (lineitem to orders) stay sort-merge joins on the key.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# exact sum of 64-bit integers as DECIMAL(38,0): three 64-bit sums of 21 bits each (the first: 22) can't overflow below 2^41
# rows, and a row costs three additions instead of one of decimals; they are put together in 64 bits where that holds them
_HIGH, _MID, _LOW = "SUM(SHIFTRIGHT({0}, 42))", "SUM(SHIFTRIGHT({0}, 21) & 2097151)", "SUM({0} & 2097151)"
LIMB_SUM = (f"CASE WHEN {_HIGH} BETWEEN -1048576 AND 1048575 AND {_MID} < 1099511627776 AND {_LOW} < 1099511627776 "
            f"THEN CAST({_HIGH} * 4398046511104 + {_MID} * 2097152 + {_LOW} AS DECIMAL(38,0)) "
            f"ELSE CAST(CAST({_HIGH} AS DECIMAL(38,0)) * 4398046511104 + CAST({_MID} AS DECIMAL(38,0)) * 2097152 + {_LOW} AS DECIMAL(38,0)) END")


@dataclass
class LogicalTable:  # M1
    name: str
    loader: Callable[[], DataFrame]
    primary_key: list[str]
    synonyms: list[str] = field(default_factory=list)
    comment: str = ""
    # dimensions that together tell a row's primary key: grouped by them, rows that lie by key stay where they are
    row_dims: list[str] = field(default_factory=list)


@dataclass
class Relationship:  # M2
    name: str
    from_table: str
    from_columns: list[str]
    to_table: str
    to_columns: list[str]


@dataclass
class Fact:  # M3
    name: str
    table: str
    expr: str
    synonyms: list[str] = field(default_factory=list)
    comment: str = ""
    requires: list[str] = field(default_factory=list)  # other tables on the path the expr reads


@dataclass
class Dimension:  # M4
    name: str
    table: str
    expr: str
    synonyms: list[str] = field(default_factory=list)
    comment: str = ""


@dataclass
class Metric:
    """Aggregate over one base table. ``expr`` may use the table's facts and any column on its path."""
    name: str
    table: str
    expr: str
    synonyms: list[str] = field(default_factory=list)
    comment: str = ""
    cast: str | None = None  # result type, e.g. "double" for exact decimal sums shown as doubles
    # optional decomposition for eager aggregation: partial aggregates ``(sum|wsum|count|min|max|
    # distinct, expr)`` (``wsum``: exact sum of integers accumulated as DECIMAL(38,0), for money in cents;
    # ``distinct``: a HyperLogLog sketch, standard error about 0.8 %, read by HLL_SKETCH_ESTIMATE)
    # and a final expression over them (``{0}``, ``{1}``.. name the partials); must equal ``expr``
    parts: list[tuple[str, str]] | None = None
    final: str | None = None


@dataclass
class DerivedMetric:
    """Arithmetic over other metrics (M24 kind), computed after aggregation."""
    name: str
    expr: str
    uses: list[str]
    synonyms: list[str] = field(default_factory=list)
    comment: str = ""
    cast: str | None = None


class ModelError(ValueError):
    pass


def _fold(s: str) -> str:
    """Case- and accent-insensitive key for synonym lookup."""
    s = unicodedata.normalize("NFKD", s)
    return "".join(ch for ch in s if not unicodedata.combining(ch)).casefold().strip()


class SemanticModel:
    def __init__(self, name: str, comment: str = ""):
        self.name, self.comment = name, comment
        self.tables: dict[str, LogicalTable] = {}
        self.relationships: list[Relationship] = []
        self.facts: dict[str, Fact] = {}
        self.dimensions: dict[str, Dimension] = {}
        self.metrics: dict[str, Metric | DerivedMetric] = {}

    # ---- definition -------------------------------------------------------------------------
    def table(self, *a, **k) -> "SemanticModel":
        t = LogicalTable(*a, **k)
        self.tables[t.name] = t
        return self

    def relate(self, *a, **k) -> "SemanticModel":
        r = Relationship(*a, **k)
        for t in (r.from_table, r.to_table):
            if t not in self.tables:
                raise ModelError(f"relationship {r.name}: unknown table {t}")
        if list(r.to_columns) != list(self.tables[r.to_table].primary_key):
            raise ModelError(f"relationship {r.name} must reference the primary key of {r.to_table}")
        self.relationships.append(r)
        return self

    def fact(self, *a, **k) -> "SemanticModel":
        f = Fact(*a, **k)
        self._unique(f.name)
        self.facts[f.name] = f
        return self

    def dimension(self, *a, **k) -> "SemanticModel":
        d = Dimension(*a, **k)
        self._unique(d.name)
        self.dimensions[d.name] = d
        return self

    def metric(self, *a, **k) -> "SemanticModel":
        m = Metric(*a, **k)
        self._unique(m.name)
        self.metrics[m.name] = m
        return self

    def derived(self, *a, **k) -> "SemanticModel":
        m = DerivedMetric(*a, **k)
        self._unique(m.name)
        for u in m.uses:
            if not isinstance(self.metrics.get(u), Metric):
                raise ModelError(f"derived metric {m.name} uses unknown base metric {u}")
        self.metrics[m.name] = m
        return self

    def _unique(self, name: str) -> None:
        if name in self.facts or name in self.dimensions or name in self.metrics:
            raise ModelError(f"duplicate name {name}")

    # ---- paths --------------------------------------------------------------------------------
    def path(self, src: str, dst: str) -> list[Relationship]:
        """Shortest chain of many-to-one relationships from ``src`` to ``dst``; error if none."""
        if src == dst:
            return []
        prev: dict[str, Relationship] = {}
        seen, q = {src}, deque([src])
        while q:
            cur = q.popleft()
            for r in self.relationships:
                if r.from_table == cur and r.to_table not in seen:
                    prev[r.to_table] = r
                    if r.to_table == dst:
                        out, node = [], dst
                        while node != src:
                            out.append(prev[node])
                            node = prev[node].from_table
                        return out[::-1]
                    seen.add(r.to_table)
                    q.append(r.to_table)
        raise ModelError(f"no many-to-one path from {src} to {dst}: the dimension is finer than "
                         f"the metric or belongs to another star")

    # ---- planning -----------------------------------------------------------------------------
    def _names_in(self, text: str | None, pool: Iterable[str]) -> list[str]:
        if not text:
            return []
        return [n for n in pool if re.search(rf"(?<![\w.]){re.escape(n)}(?!\w)", text)]

    def _joins_for(self, base: str, dims: list[str], needs: list[str]) -> list[Relationship]:
        """Relationships to join from ``base``, each after the one that brings its ``from`` table."""
        tables_needed = {self.dimensions[d].table for d in dims}
        for f in needs:
            if f in self.facts:
                tables_needed.add(self.facts[f].table)
                tables_needed.update(self.facts[f].requires)
        joins: list[Relationship] = []
        for t in sorted(tables_needed):
            for r in self.path(base, t):
                if r not in joins:
                    joins.append(r)
        return joins

    def _scan(self, table: str, scan: dict[str, Column] | None) -> DataFrame:
        """The table, with the caller's predicate on its raw columns right on the scan."""
        df = self.tables[table].loader()
        return df.where(scan[table]) if scan and table in scan else df

    def _eager_part(self, base: str, ms: list[Metric], dims: list[str], where, where_dims: list[str],
                    scan: dict[str, Column] | None = None) -> DataFrame:
        """Aggregate before every join (eager aggregation) for decomposable metrics.

        The fact table is reduced to one row per (local dimensions, foreign keys) first; each join
        then meets at most one row per key of the next table, and the partials are re-aggregated
        after it. For a star path (lines -> supplies -> customers -> cities) the big shuffle carries
        pre-aggregated rows and the later joins see one row per supply, then per customer.
        """
        keep = list(dict.fromkeys(dims + where_dims))
        parts: list[tuple[str, str, str]] = []
        finals: dict[str, str] = {}
        for m in ms:
            names = []
            for agg, expr in m.parts:
                n = f"_p{len(parts)}"
                parts.append((n, agg, expr))
                names.append(n)
            finals[m.name] = m.final.format(*names)
        first = {"sum": "SUM({0})", "wsum": "SUM({0})", "limbs": LIMB_SUM, "count": "COUNT({0})", "min": "MIN({0})", "max": "MAX({0})",
                 "distinct": "HLL_SKETCH_AGG({0}, 14)"}
        # counts merge by summing and are never null (an empty global aggregate counts 0)
        merge = {"sum": F.sum, "wsum": lambda c: F.sum(c.cast("decimal(38,0)")),
                 "count": lambda c: F.coalesce(F.sum(c), F.lit(0)), "min": F.min, "max": F.max,
                 "distinct": F.hll_union_agg}
        fact_names = self._names_in(" ".join(e for _, _, e in parts), self.facts)
        pending = self._joins_for(base, keep, fact_names)
        row = self.tables[base]
        own = [c for c in row.primary_key if c not in keep] if row.row_dims and set(row.row_dims) <= set(keep) else []

        def dims_of(table):
            return [d for d in keep if self.dimensions[d].table == table]

        def fks(joined, todo):
            """Foreign keys still needed: joins not yet made whose ``from`` table is present (a key
            already carried as a same-named dimension is not added twice)."""
            return list(dict.fromkeys(c for r in todo for c in r.from_columns
                                      if r.from_table in joined and r.to_table not in joined and c not in keep))

        def merged():
            return [merge[agg](F.col(n)).alias(n) for n, agg, _ in parts]

        def where_ok(have):
            return where is not None and all(d in have for d in where_dims)

        def filt(df):
            return df.where(where if isinstance(where, Column) else F.expr(where))

        joined, have = {base}, dims_of(base)
        src = self._scan(base, scan)
        for r in pending:
            # a filtered table next to the base cuts the base rows before anything is aggregated or shuffled
            if scan and r.from_table == base and r.to_table in scan:
                keys = self._scan(r.to_table, scan).select(*[F.col(c).alias(f"_s{j}") for j, c in enumerate(r.to_columns)])
                on = [src[c] == keys[f"_s{j}"] for j, c in enumerate(r.from_columns)]
                src = src.join(keys, on, "left_semi")
        if fact_names:
            src = src.withColumns({f: F.expr(self.facts[f].expr) for f in fact_names})
        # the input of every partial is evaluated on the fact rows (facts and raw columns alike)
        kinds = src.select(*[F.expr(expr).alias(n) for n, _, expr in parts]).schema
        limbs = {n for n, agg, _ in parts if agg == "wsum" and isinstance(kinds[n].dataType, (T.LongType, T.IntegerType))}
        keys = list(dict.fromkeys([*fks(joined, pending), *own]))
        cur = src.select(*[F.expr(self.dimensions[d].expr).alias(d) for d in have],
                         *[(F.expr(expr).cast("long" if n in limbs else "decimal(38,0)") if agg == "wsum" else F.expr(expr)).alias(f"{n}_in")
                           for n, agg, expr in parts],
                         *[F.col(c) for c in keys])
        applied = where_ok(have)
        if applied:
            cur = filt(cur)  # filter on local dimensions before any aggregation (pushdown)
        cur = cur.groupBy(*have, *keys).agg(
            *[F.expr(first["limbs" if n in limbs else agg].format(f"{n}_in")).alias(n) for n, agg, _ in parts])
        for i, r in enumerate(pending):
            if r.to_table in joined:
                continue
            rest = pending[i + 1:]
            rdims = dims_of(r.to_table)
            rfks = list(dict.fromkeys(c for rr in rest for c in rr.from_columns
                                      if rr.from_table == r.to_table and c not in rdims))
            right = self._scan(r.to_table, scan).select(
                *[F.col(c).alias(f"_k{j}") for j, c in enumerate(r.to_columns)],
                *[F.expr(self.dimensions[d].expr).alias(d) for d in rdims], *[F.col(c) for c in rfks])
            cond = None
            for j, a in enumerate(r.from_columns):
                c = cur[a] == right[f"_k{j}"]
                cond = c if cond is None else cond & c
            # left: a dangling key keeps its partials, with null dimension values
            cur = cur.join(right, cond, "left").drop(*[f"_k{j}" for j in range(len(r.to_columns))])
            joined.add(r.to_table)
            have = have + rdims
            if not applied and where_ok(have):
                cur, applied = filt(cur), True
            if any(rr.to_table not in joined for rr in rest):
                cur = cur.groupBy(*have, *fks(joined, rest)).agg(*merged())
        if where is not None and not applied:
            cur = filt(cur)
        if own and not pending and set(dims) == set(have):
            out = cur                                       # already one row per group
        else:
            out = cur.groupBy(*[F.col(d) for d in dims]).agg(*merged()) if dims else cur.agg(*merged())
        sel = []
        for m in ms:
            c = F.expr(finals[m.name])
            sel.append((c.cast(m.cast) if m.cast else c).alias(m.name))
        return out.select(*dims, *sel)

    def _base_rows(self, base: str, dims: list[str], extra_dims: list[str], needs: list[str],
                   scan: dict[str, Column] | None = None) -> DataFrame:
        """Fact rows of ``base`` with every needed table joined along many-to-one paths."""
        tables_needed = {self.dimensions[d].table for d in dims + extra_dims}
        for f in needs:
            if f in self.facts:
                tables_needed.add(self.facts[f].table)
                tables_needed.update(self.facts[f].requires)
        joins: list[Relationship] = []
        for t in sorted(tables_needed):
            for r in self.path(base, t):
                if r not in joins:
                    joins.append(r)
        df = self._scan(base, scan).alias(base)
        joined = {base}
        for r in joins:
            if r.to_table in joined:
                continue
            right = self._scan(r.to_table, scan).alias(r.to_table)
            cond = None
            for a, b in zip(r.from_columns, r.to_columns):
                c = F.col(f"{r.from_table}.{a}") == F.col(f"{r.to_table}.{b}")
                cond = c if cond is None else cond & c
            # left: a fact with a dangling key is kept (its dimension values are null)
            df = df.join(right, cond, "left")
            joined.add(r.to_table)
        return df

    def query(self, metrics: list[str], dimensions: list[str] | None = None,
              where: str | Column | None = None, order_by: list[str | Column] | None = None,
              limit: int | None = None, where_dims: list[str] | None = None, eager: bool = True,
              scan: dict[str, Column] | None = None) -> DataFrame:
        """Aggregate ``metrics`` at ``dimensions``.

        ``where`` is a SQL string over dimension names (they are found by name) or a ``Column``; for a
        ``Column`` list the dimensions it reads in ``where_dims``. ``scan`` gives predicates on raw columns
        by table that ``where`` implies; they go on the scans, where they prune files and row groups.
        """
        dims = list(dimensions or [])
        for d in dims:
            if d not in self.dimensions:
                raise ModelError(f"unknown dimension {d}")
        base_metrics: list[str] = []
        for m in metrics:
            mm = self.metrics.get(m)
            if mm is None:
                raise ModelError(f"unknown metric {m}")
            for u in (mm.uses if isinstance(mm, DerivedMetric) else [m]):
                if u not in base_metrics:
                    base_metrics.append(u)
        if isinstance(where, Column):
            where_dims = list(where_dims or [])
        else:
            where_dims = self._names_in(where, self.dimensions)
        by_table: dict[str, list[Metric]] = {}
        for m in base_metrics:
            mm = self.metrics[m]
            by_table.setdefault(mm.table, []).append(mm)

        parts: list[DataFrame] = []
        for base, ms in by_table.items():
            for d in dims + where_dims:  # grain check before any plan is built
                self.path(base, self.dimensions[d].table)
            fact_names = self._names_in(" ".join(m.expr for m in ms), self.facts)
            local_facts = all(not self.facts[f].requires for f in
                              self._names_in(" ".join(e for m in ms for _, e in (m.parts or [])), self.facts))
            if eager and all(m.parts and m.final for m in ms) and local_facts:
                parts.append(self._eager_part(base, ms, dims, where, where_dims, scan))
                continue
            rows = self._base_rows(base, dims, where_dims, fact_names, scan)
            # dimensions and facts are added by name (a same-named raw column is replaced, never
            # duplicated); raw columns referenced directly by metric expressions stay available
            new_cols = {d: F.expr(self.dimensions[d].expr) for d in dict.fromkeys(dims + where_dims)}
            new_cols.update({f: F.expr(self.facts[f].expr) for f in fact_names})
            rows = rows.withColumns(new_cols) if new_cols else rows
            if where is not None:
                rows = rows.where(where if isinstance(where, Column) else F.expr(where))
            aggs = []
            for m in ms:
                c = F.expr(m.expr)
                aggs.append((c.cast(m.cast) if m.cast else c).alias(m.name))
            part = rows.groupBy(*[F.col(d) for d in dims]).agg(*aggs) if dims else rows.agg(*aggs)
            parts.append(part)

        out = parts[0]
        if len(parts) > 1:
            # drill-across: every metric is non-null in exactly one part, so stacking the
            # pre-aggregated parts and taking max per metric at the shared dimensions is exact; one
            # shuffle on the dimensions (null keys group together, like a null-safe full outer join)
            for p in parts[1:]:
                out = out.unionByName(p, allowMissingColumns=True)
            names = [c for c in out.columns if c not in dims]
            out = (out.groupBy(*[F.col(d) for d in dims]).agg(*[F.max(c).alias(c) for c in names]) if dims
                   else out.agg(*[F.max(c).alias(c) for c in names]))
        for m in metrics:
            mm = self.metrics[m]
            if isinstance(mm, DerivedMetric):
                c = F.expr(mm.expr)
                out = out.withColumn(m, c.cast(mm.cast) if mm.cast else c)
        out = out.select(*dims, *metrics)
        if order_by:
            out = out.orderBy(*order_by)
        if limit is not None:
            if not order_by:
                raise ModelError("limit needs an order_by (results would be arbitrary)")
            out = out.limit(limit)
        return out

    # ---- catalogue (M5, M6) -----------------------------------------------------------------
    def entries(self) -> list[tuple[str, str, str, str, str]]:
        rows = [("table", t.name, t.name, ",".join(t.primary_key), t.comment) for t in self.tables.values()]
        rows += [("relationship", r.name, r.from_table,
                  f"{','.join(r.from_columns)} -> {r.to_table}({','.join(r.to_columns)})", "")
                 for r in self.relationships]
        rows += [("fact", f.name, f.table, f.expr, f.comment) for f in self.facts.values()]
        rows += [("dimension", d.name, d.table, d.expr, d.comment) for d in self.dimensions.values()]
        for m in self.metrics.values():
            if isinstance(m, DerivedMetric):
                rows.append(("metric", m.name, "", m.expr, m.comment))
            else:
                rows.append(("metric", m.name, m.table, m.expr, m.comment))
        return rows

    def describe(self, spark: SparkSession) -> DataFrame:
        """M6: the model as a DataFrame (kind, name, table, definition, comment)."""
        schema = "kind string, name string, table string, definition string, comment string"
        return spark.createDataFrame(self.entries(), schema)

    def synonym_rows(self) -> list[tuple[str, str, str]]:
        out = []
        for kind, pool in (("table", self.tables), ("fact", self.facts), ("dimension", self.dimensions),
                           ("metric", self.metrics)):
            for name, obj in pool.items():
                for term in [name, *obj.synonyms]:
                    out.append((term, kind, name))
        return out

    def synonyms(self, spark: SparkSession) -> DataFrame:
        """M5 lookup table (term, kind, name, key); ``key`` is the case- and accent-folded term."""
        rows = [(t, k, n, _fold(t)) for t, k, n in self.synonym_rows()]
        return spark.createDataFrame(rows, "term string, kind string, name string, key string")

    def resolve_terms(self, terms: DataFrame, term_col: str = "term") -> DataFrame:
        """Join business terms to model entries, ignoring case and accents (UNICODE_CI_AI collation)."""
        spark = terms.sparkSession
        syn = self.synonyms(spark).select(
            F.col("term").alias("matched_term"), "kind", "name")
        left = terms.withColumn("_k", F.expr(f"collate({term_col}, 'UNICODE_CI_AI')"))
        right = syn.withColumn("_k2", F.expr("collate(matched_term, 'UNICODE_CI_AI')"))
        # the synonym table is model metadata (hundreds of rows), so it is broadcast
        return left.join(F.broadcast(right), F.col("_k") == F.col("_k2"), "left").drop("_k", "_k2")

    def lookup(self, term: str) -> list[tuple[str, str]]:
        key = _fold(term)
        return sorted({(k, n) for t, k, n in self.synonym_rows() if _fold(t) == key})

