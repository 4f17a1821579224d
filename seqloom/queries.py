"""Registered queries over the test tables, and their SQL.

Sequences: ``ev`` is events in order of event_id (symbols: event types), ``li`` lineitem in order of
(l_orderkey, l_linenumber, l_partkey, l_suppkey) (part keys), ``usr`` the events of each user in time,
``docs`` the words of each whole document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.draws import PRIME, draw_sql
from .operators import bwt, ngram, packed, runs, search, stats, suffix
from .plans import index
from .plans.lineage import cut, shared_dir, stamp
from .plans.order import numbered
from .plans.sequence import Sequence, from_table, pattern_ids, separated
from .sources.intseq import WIDTHS, read_ints, read_patterns, save_ints, write_counts
from .sources.synthetic import CHOICE, FOLLOWER, FOLLOWERS, SPREAD, START, STRETCH, WHAT, WHERE, generate, thresholds

#: Alphabet, base length, copies and mutation probability of the synthetic sequence.
SYNTHETIC = (60, 900, 6, 0.02)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_made: dict[tuple, object] = {}


def forget() -> None:
    """Let go of all shared tables, so that the next queries build their own."""
    _made.clear()


def _once(name: str, spark: SparkSession, sf_dir: str, make):
    """Tables that several queries share are built once for each session, folder and state of its files."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir), name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _sequence(name: str, spark: SparkSession, sf_dir: str) -> Sequence:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    make = {
        "ev": lambda: from_table(read("events"), ["event_id"], "event_type"),
        "li": lambda: from_table(read("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_partkey"),
        "usr": lambda: from_table(read("events"), ["ts", "event_id"], "event_type", group="user_id"),
        "docs": lambda: from_table(read("documents").select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).alias("pos", "word")), ["pos"], "word", group="doc_id"),
        "syn": lambda: from_table(generate(spark, *SYNTHETIC), ["pos"], "val"),
    }[name]
    return _once(f"seq {name}", spark, sf_dir, make)


def _built(name: str, spark: SparkSession, sf_dir: str) -> index.Built:
    return _once(f"index {name}", spark, sf_dir, lambda: index.build(_sequence(name, spark, sf_dir)))


def _plain(name: str, spark: SparkSession, sf_dir: str):
    return _once(f"plain {name}", spark, sf_dir, lambda: index.build_plain(_sequence(name, spark, sf_dir)))


def _suffixes(name: str, spark: SparkSession, sf_dir: str) -> suffix.Suffixes:
    def make():
        s = _sequence(name, spark, sf_dir)
        return suffix.suffix_array(s.seq, s.n)

    return _once(f"sa {name}", spark, sf_dir, make)


def _generalized(name: str, spark: SparkSession, sf_dir: str):
    return _once(f"gsa {name}", spark, sf_dir, lambda: suffix.generalized(_sequence(name, spark, sf_dir), lcps=name != "docs"))


def _grams(name: str, m: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct m-gram as a pattern."""
    shown = F.array_join("p", "-")
    return _once(f"grams {name} {m}", spark, sf_dir, lambda: cut(ngram.ngram_counts(_sequence(name, spark, sf_dir), m).select(shown.alias("pid"), "p")))


def _add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


_RAW = {
    "ev": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS k, event_type AS val, 0 AS grp FROM events",
    "li": "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS k, l_partkey AS val, 0 AS grp FROM lineitem",
    "usr": "SELECT row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS k, event_type AS val, user_id AS grp FROM events",
}


def _sql(name: str, *parts: str) -> str:
    """WITH the sequence as t(k, id, grp) and its dictionary d(val, id), then further tables, then a query."""
    head = f"WITH raw AS ({_RAW[name]}), d AS (SELECT val, row_number() OVER (ORDER BY val) AS id FROM (SELECT DISTINCT val FROM raw)), t AS (SELECT k, id, grp FROM raw JOIN d USING (val))"
    return ", ".join([head, *parts[:-1]]) + " " + parts[-1]


_PAIRS = "w AS (SELECT k, id AS a, lead(id) OVER (PARTITION BY grp ORDER BY k) AS b FROM t), big AS (SELECT a, b, count(*) AS cnt FROM w WHERE b IS NOT NULL GROUP BY a, b)"
_SUCC = _PAIRS + ", succ AS (SELECT a, b, cnt, row_number() OVER (PARTITION BY a ORDER BY cnt DESC, b) AS rk FROM big)"
_S = _SUCC + ", s AS (SELECT w.k, w.a AS id, coalesce(succ.rk, 0) AS s FROM w LEFT JOIN succ ON w.a = succ.a AND w.b = succ.b)"
#: Suffixes in order; 32 symbols tell all of them apart in ev.
_SA = "x AS (SELECT k, list(id) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS l FROM t), sa AS (SELECT row_number() OVER (ORDER BY l, k DESC) - 1 AS r, k, l FROM x)"
_SA_S = "xs AS (SELECT k, list(s) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS l FROM s), sas AS (SELECT row_number() OVER (ORDER BY l, k DESC) - 1 AS r, k, l FROM xs)"
_LCP = "coalesce(nullif(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]), true), 0) - 1, least(len(a), len(b)))"
_BWT_S = "ls AS (SELECT sas.r AS i, CAST(s.s AS BIGINT) AS l FROM sas JOIN s ON s.k = CASE WHEN sas.k = 0 THEN (SELECT max(k) FROM s) ELSE sas.k - 1 END)"
_PSI = "ps AS (SELECT sas.r AS i, t.id AS p FROM sas JOIN t USING (k))"


def _runs_sql(table: str, column: str) -> str:
    return f"fl AS (SELECT i, {column} AS c, CASE WHEN lag({column}) OVER (ORDER BY i) IS DISTINCT FROM {column} THEN 1 ELSE 0 END AS f FROM {table}), g AS (SELECT i, c, sum(f) OVER (ORDER BY i) AS g FROM fl), rn AS (SELECT c, min(i) AS start, count(*) AS len FROM g GROUP BY g, c)"


def _gram_sql(m: int) -> str:
    names = ", ".join(f"lead(id, {j}) OVER (PARTITION BY grp ORDER BY k) AS x{j}" for j in range(m))
    return f"SELECT concat_ws('-', {', '.join(f'x{j}' for j in range(m))}) AS p, count(*) AS n_occ FROM (SELECT {names} FROM t) WHERE x{m - 1} IS NOT NULL GROUP BY ALL"


for _n in ("ev", "li"):
    _add(f"dict_{_n}", lambda sp, d, n=_n: _sequence(n, sp, d).dict, _sql(_n, "SELECT val, id FROM d"))
    _add(f"hist_{_n}", lambda sp, d, n=_n: stats.histogram(_sequence(n, sp, d).seq), _sql(_n, "SELECT id AS sym, count(*) AS cnt FROM t GROUP BY id"))
    _add(f"entropy_{_n}", lambda sp, d, n=_n: stats.entropy(_sequence(n, sp, d).seq).select(F.round("h0", 6).alias("h0")), _sql(_n, "c AS (SELECT count(*) AS c FROM t GROUP BY id)", "SELECT round(sum(-(c / n) * log2(c / n)), 6) AS h0 FROM c, (SELECT count(*) AS n FROM t)"))
    _add(f"succ_rank_{_n}", lambda sp, d, n=_n: stats.successors(_sequence(n, sp, d)), _sql(_n, _SUCC, "SELECT a, b, cnt, rk FROM succ"))
    _add(f"encode_s_{_n}", lambda sp, d, n=_n: stats.encode(_sequence(n, sp, d)), _sql(_n, _S, "SELECT k, id, s FROM s"))
    _add(f"summary_{_n}", lambda sp, d, n=_n: stats.summary(_sequence(n, sp, d)).withColumn("h0", F.round("h0", 6)), _sql(_n, _SUCC, "c AS (SELECT count(*) AS c FROM t GROUP BY id)", "SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM d) AS sigma, (SELECT count(*) FROM succ) AS bigrams, (SELECT coalesce(max(rk), 0) + 1 FROM succ) AS \"kE\", (SELECT round(sum(-(c / n) * log2(c / n)), 6) FROM c, (SELECT count(*) AS n FROM t)) AS h0"))
for _n in ("ev", "li", "usr"):
    _add(f"bigrams_{_n}", lambda sp, d, n=_n: stats.bigrams(_sequence(n, sp, d)), _sql(_n, _PAIRS, "SELECT a, b, cnt FROM big"))
_add("encode_ids_li", lambda sp, d: _sequence("li", sp, d).seq.select("k", "id"), _sql("li", "SELECT k, id FROM t"))
_add("succ_top3_li", lambda sp, d: stats.successors(_sequence("li", sp, d)).where("rk <= 3"), _sql("li", _SUCC, "SELECT a, b, cnt, rk FROM succ WHERE rk <= 3"))
_add("c_array_ev", lambda sp, d: _built("ev", sp, d).index.base, _sql("ev", _S, "h AS (SELECT s AS sym, count(*) AS cnt FROM s GROUP BY s)", "SELECT q.sym, CAST(coalesce((SELECT sum(cnt) FROM h WHERE h.sym < q.sym), 0) AS BIGINT) AS base FROM (SELECT unnest(range(0, (SELECT max(rk) + 2 FROM succ))) AS sym) q"))

_add("sa_ev", lambda sp, d: _suffixes("ev", sp, d).sa, _sql("ev", _SA, "SELECT r, k FROM sa"))
_add("sa_s_ev", lambda sp, d: _built("ev", sp, d).suffixes.sa, _sql("ev", _S, _SA_S, "SELECT r, k FROM sas"))
_add("bwt_t_ev", lambda sp, d: _plain("ev", sp, d)[1], _sql("ev", _SA, "full_ AS (SELECT r + 1 AS i, k FROM sa UNION ALL SELECT 0, (SELECT max(k) + 1 FROM t))", "SELECT i, coalesce(t.id, 0) AS l FROM full_ LEFT JOIN t ON t.k = full_.k - 1"))
_add("bwt_s_ev", lambda sp, d: _built("ev", sp, d).bwt, _sql("ev", _S, _SA_S, _BWT_S, "SELECT i, l FROM ls"))
_add("psi_e_ev", lambda sp, d: _built("ev", sp, d).psi, _sql("ev", _S, _SA_S, _PSI, "SELECT i, p FROM ps"))


def _nosentinel(sp, d):
    return _once("bwt ev", sp, d, lambda: (lambda x: (cut(x[0]), x[1]))(bwt.plain(_suffixes("ev", sp, d))))


_add("bwt_nosentinel_ev", lambda sp, d: _nosentinel(sp, d)[0], _sql("ev", _SA, "p AS (SELECT r AS w FROM sa WHERE k = 0)", "SELECT CASE WHEN r < w THEN r + 1 ELSE r END AS i, t.id AS sym FROM sa JOIN t ON t.k = sa.k - 1 CROSS JOIN p WHERE sa.k > 0 UNION ALL SELECT 0, id FROM t WHERE k = (SELECT max(k) FROM t)"))
_add("primary_index_ev", lambda sp, d: sp.range(1).select(F.lit(_nosentinel(sp, d)[1]).cast("long").alias("primary_index")), _sql("ev", _SA, "SELECT r + 1 AS primary_index FROM sa WHERE k = 0"))
_add("bwt_aux_ev", lambda sp, d: bwt.auxiliary(_suffixes("ev", sp, d), 16), _sql("ev", _SA, "SELECT k // 16 AS t, r + 1 AS isa1 FROM sa WHERE k % 16 = 0"))
_add("unbwt_ev", lambda sp, d: bwt.inverse_primary(_nosentinel(sp, d)[0], _sequence("ev", sp, d).n, _nosentinel(sp, d)[1]), _sql("ev", "SELECT k, id FROM t"))
_add("unbwt_aux_ev", lambda sp, d: bwt.inverse(_nosentinel(sp, d)[0], _sequence("ev", sp, d).n, bwt.auxiliary(_suffixes("ev", sp, d), 16), 16), _sql("ev", "SELECT k, id FROM t"))
_add("lcp_ev", lambda sp, d: suffix.lcp(_suffixes("ev", sp, d)), _sql("ev", _SA, "n AS (SELECT r, k, l AS a, lag(l) OVER (ORDER BY r) AS b FROM sa)", f"SELECT r, k, CASE WHEN b IS NULL THEN 0 ELSE {_LCP} END AS lcp FROM n"))
_add("plcp_ev", lambda sp, d: suffix.plcp(_suffixes("ev", sp, d)), _sql("ev", _SA, "n AS (SELECT r, k, l AS a, lag(l) OVER (ORDER BY r) AS b FROM sa)", f"SELECT k, CASE WHEN b IS NULL THEN 0 ELSE {_LCP} END AS plcp FROM n"))


def _placed(name, sp, d):
    """(r, grp, pos) of a generalized suffix array; pos = length is the separator."""
    x, flat = _generalized(name, sp, d)
    s = _sequence(name, sp, d)
    first, _ = numbered(s.seq.groupBy("grp").agg(F.min("k").alias("first"), F.count("*").alias("len")), ["grp"], "g")
    offsets = first.select("grp", (F.col("first") + F.col("g")).alias("begin"), "len")
    at = offsets.select("grp", "begin", F.explode(F.sequence(F.lit(0).cast("long"), "len")).alias("pos")).select("grp", "pos", (F.col("begin") + F.col("pos")).alias("k"))
    return x.sa.join(at, "k").select("r", "grp", "pos")


_GSA = "m AS (SELECT grp, k, row_number() OVER (PARTITION BY grp ORDER BY k) - 1 AS pos, list(id) OVER (PARTITION BY grp ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM t), e AS (SELECT grp, pos, l FROM m UNION ALL SELECT grp, count(*), [] FROM t GROUP BY grp), gs AS (SELECT row_number() OVER (ORDER BY l, grp) - 1 AS r, grp, pos, l FROM e)"
_add("gsa_usr", lambda sp, d: _placed("usr", sp, d), _sql("usr", _GSA, "SELECT r, grp, pos FROM gs"))
_add("glcp_usr", lambda sp, d: suffix.lcp(_generalized("usr", sp, d)[0]).select("r", "lcp"), _sql("usr", _GSA, "n AS (SELECT r, l AS a, lag(l) OVER (ORDER BY r) AS b FROM gs)", f"SELECT r, CASE WHEN b IS NULL THEN 0 ELSE {_LCP} END AS lcp FROM n"))


def _documents(sp, d) -> DataFrame:
    return sp.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _gsa_docs(sp, d):
    """The same of the words of documents, on packed arrays unless too many suffixes begin alike for a task."""
    docs = _documents(sp, d)
    try:
        return packed.array(packed.documents(docs), sp, docs.schema["doc_id"].dataType)
    except packed.TooLarge:
        return _placed("docs", sp, d)


_add("gsa_docs", _gsa_docs)


def _rounds(name: str, spark: SparkSession, sf_dir: str) -> suffix.Suffixes:
    """The same array by distributed rounds, however short the sequence is."""

    def make():
        s = _sequence(name, spark, sf_dir)
        return suffix.generalized(s, local=0)[0] if s.grouped else suffix.suffix_array(s.seq, s.n, local=0)

    return _once(f"rounds {name}", spark, sf_dir, make)


_LCP_SQL = f"SELECT r, k, CASE WHEN b IS NULL THEN 0 ELSE {_LCP} END AS lcp FROM n"
_add("sa_li", lambda sp, d: _suffixes("li", sp, d).sa, _sql("li", _SA, "SELECT r, k FROM sa"))
_add("lcp_li", lambda sp, d: suffix.lcp(_suffixes("li", sp, d)), _sql("li", _SA, "n AS (SELECT r, k, l AS a, lag(l) OVER (ORDER BY r) AS b FROM sa)", _LCP_SQL))
_add("sa_rounds_ev", lambda sp, d: _rounds("ev", sp, d).sa, _sql("ev", _SA, "SELECT r, k FROM sa"))
_add("sa_rounds_li", lambda sp, d: _rounds("li", sp, d).sa, _sql("li", _SA, "SELECT r, k FROM sa"))
_add("lcp_rounds_ev", lambda sp, d: suffix.lcp(_rounds("ev", sp, d)), _sql("ev", _SA, "n AS (SELECT r, k, l AS a, lag(l) OVER (ORDER BY r) AS b FROM sa)", _LCP_SQL))
_add("lcp_rounds_li", lambda sp, d: suffix.lcp(_rounds("li", sp, d)), _sql("li", _SA, "n AS (SELECT r, k, l AS a, lag(l) OVER (ORDER BY r) AS b FROM sa)", _LCP_SQL))
_add("glcp_rounds_usr", lambda sp, d: suffix.lcp(_rounds("usr", sp, d)).select("r", "lcp"), _sql("usr", _GSA, "n AS (SELECT r, l AS a, lag(l) OVER (ORDER BY r) AS b FROM gs)", f"SELECT r, CASE WHEN b IS NULL THEN 0 ELSE {_LCP} END AS lcp FROM n"))


def _heads(sp, d):
    """For each pair of words: how many suffixes of documents begin with it, and the first and last of their ranks."""
    return packed.heads(packed.documents(_documents(sp, d)), sp)


_add(
    "gsa_docs_heads",
    _heads,
    r"WITH w AS (SELECT doc_id AS grp, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS l FROM documents), raw AS (SELECT grp, unnest(l) AS val, unnest(range(len(l))) AS pos FROM w),"
    " d AS (SELECT val, row_number() OVER (ORDER BY encode(val)) AS id FROM (SELECT DISTINCT val FROM raw)), t AS (SELECT grp, pos, id FROM raw JOIN d USING (val)),"
    " p AS (SELECT id AS a, lead(id) OVER (PARTITION BY grp ORDER BY pos) AS b FROM t), c AS (SELECT a, b, count(*) AS cnt FROM p GROUP BY a, b), g AS (SELECT count(*) AS n FROM w WHERE len(l) > 0),"
    " o AS (SELECT a, b, cnt, (SELECT n FROM g) + sum(cnt) OVER (ORDER BY a, b NULLS FIRST) - cnt AS low FROM c)"
    " SELECT a, b, cnt, CAST(low AS BIGINT) AS low, CAST(low + cnt - 1 AS BIGINT) AS high FROM o WHERE b IS NOT NULL",
)

_add("runs_bwt_ev", lambda sp, d: _built("ev", sp, d).index.bwt_runs.select("c", "start", "len", "cum"), _sql("ev", _S, _SA_S, _BWT_S, _runs_sql("ls", "l"), "SELECT c, start, len, CAST(coalesce(sum(len) OVER (PARTITION BY c ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM rn"))
_add("runlen_psi_ev", lambda sp, d: _built("ev", sp, d).index.psi_runs.groupBy("len").agg(F.count("*").alias("n_runs")), _sql("ev", _S, _SA_S, _PSI, _runs_sql("ps", "p"), "SELECT len, count(*) AS n_runs FROM rn GROUP BY len"))
_add("run_totals_ev", lambda sp, d: runs.totals(_built("ev", sp, d).index.bwt_runs), _sql("ev", _S, _SA_S, _BWT_S, _runs_sql("ls", "l"), "SELECT c, count(*) AS n_runs, CAST(sum(len) AS BIGINT) AS total FROM rn GROUP BY c"))
_add("run_counts_ev", lambda sp, d: sp.range(1).select(F.lit(runs.count_runs(_built("ev", sp, d).bwt, "l")).cast("long").alias("n_runs")), _sql("ev", _S, _SA_S, _BWT_S, _runs_sql("ls", "l"), "SELECT count(*) AS n_runs FROM rn"))
_add("rank_probe_ev", lambda sp, d: runs.rank(_built("ev", sp, d).index.psi_runs, _sequence("ev", sp, d).dict.select(F.col("id").alias("c")).crossJoin(sp.range(_sequence("ev", sp, d).n + 1).select(F.col("id").alias("i")))), _sql("ev", _S, _SA_S, _PSI, "q AS (SELECT d.id AS c, j.i FROM d, (SELECT unnest(range(0, (SELECT count(*) + 1 FROM t))) AS i) j)", "SELECT q.c, q.i, CAST(coalesce(sum(CASE WHEN ps.p = q.c THEN 1 ELSE 0 END) OVER (PARTITION BY q.c ORDER BY q.i), 0) AS BIGINT) AS rank FROM q LEFT JOIN ps ON ps.i = q.i - 1"))

for _n, _m in (("ev", 3), ("li", 2)):
    _add(f"ngram{_m}_{_n}", lambda sp, d, n=_n, m=_m: ngram.ngram_counts(_sequence(n, sp, d), m).select(F.array_join("p", "-").alias("p"), "n_occ"), _sql(_n, _gram_sql(_m)))


def _counted(name: str, m: int, which: str, how: bool | None = None) -> Query:
    def run(sp, d):
        x = _built(name, sp, d).index if which == "order1" else _plain(name, sp, d)[0]
        return search.count(x, _grams(name, m, sp, d), how).select(F.col("pid").alias("p"), "n_occ")

    return run


for _m in (1, 2, 4, 8):
    _add(f"count_order1_ev_m{_m}", _counted("ev", _m, "order1"), _sql("ev", _gram_sql(_m)))
_add("count_order1_li_m2", _counted("li", 2, "order1"), _sql("li", _gram_sql(2)))
_add("count_tdollar_ev_m4", _counted("ev", 4, "plain"), _sql("ev", _gram_sql(4)))
_add("count_joined_ev_m4", _counted("ev", 4, "order1", False), _sql("ev", _gram_sql(4)))
_add("count_tdollar_joined_ev_m3", _counted("ev", 3, "plain", False), _sql("ev", _gram_sql(3)))


def _absent(sp, d):
    """Every possible 6-gram, most of them absent."""
    every = sp.range(1).select(F.array().cast("array<bigint>").alias("p"))
    ids = _sequence("ev", sp, d).dict.select("id")
    for _ in range(6):
        every = every.crossJoin(F.broadcast(ids)).select(F.array_append("p", F.col("id")).alias("p"))
    found = search.count(_built("ev", sp, d).index, every.select(F.array_join("p", "-").alias("pid"), "p"))
    return found.select(F.col("pid").alias("p"), "n_occ")


_add("count_absent_ev", _absent, _sql("ev", f"g AS ({_gram_sql(6)})", "e AS (SELECT concat_ws('-', a.id, b.id, c.id, d2.id, e.id, f.id) AS p FROM d a, d b, d c, d d2, d e, d f)", "SELECT e.p, coalesce(g.n_occ, 0) AS n_occ FROM e LEFT JOIN g USING (p)"))


def _grouped(sp, d):
    """3-grams inside users through the index of the separated sequence; symbols are shifted back for show."""
    s = _sequence("usr", sp, d)
    flat = _once("flat usr", sp, d, lambda: separated(s))
    made = _once("index flat usr", sp, d, lambda: index.build(flat))
    shift = flat.sigma - s.sigma
    patterns = _grams("usr", 3, sp, d).select("pid", F.transform("p", lambda x: x + shift).alias("p"))
    return search.count(made.index, patterns).select(F.col("pid").alias("p"), "n_occ")


_add("count_grouped_usr_m3", _grouped, _sql("usr", _gram_sql(3)))


#: Every so many positions begin a pattern of the agreement check.
EVERY = 211


def _agree(sp, d, lengths=range(1, 9)):
    """(m, p, brute, order1, plain): patterns from the sequence, each third with its last symbol replaced."""
    made, plain = _built("ev", sp, d), _plain("ev", sp, d)[0]
    s, own = made.sequence, None
    last = F.when(F.expr(f"k div {EVERY} % 3 = 0"), F.element_at("p", -1) % s.sigma + 1).otherwise(F.element_at("p", -1))
    for m in lengths:
        rows = ngram.ngrams(s, m).where(F.col("k") % EVERY == 0).select(F.concat(F.slice("p", 1, m - 1), F.array(last)).alias("p")).distinct()
        own = rows if own is None else own.unionByName(rows)
    own = cut(own.select(F.array_join("p", "-").alias("pid"), "p"))
    found = own.select("pid", F.size("p").alias("m")).join(ngram.brute_force(s, own).withColumnRenamed("n_occ", "brute"), "pid")
    for name, x in (("order1", made.index), ("plain", plain)):
        found = found.join(search.count(x, own, True).withColumnRenamed("n_occ", name), "pid")
    return found.select("m", F.col("pid").alias("p"), "brute", "order1", "plain")


def _agree_sql(lengths) -> str:
    every, parts = [], []
    for m in lengths:
        names = ", ".join(f"lead(id, {j}) OVER (ORDER BY k) AS x{j}" for j in range(m))
        every.append(f"w{m} AS (SELECT k, {names} FROM t), g{m} AS (SELECT concat_ws('-', {', '.join(f'x{j}' for j in range(m))}) AS p, count(*) AS n FROM w{m} WHERE x{m - 1} IS NOT NULL GROUP BY 1)")
        head = "".join(f"x{j} || '-' || " for j in range(m - 1))
        own = f"SELECT DISTINCT {head}CASE WHEN k // {EVERY} % 3 = 0 THEN x{m - 1} % (SELECT count(*) FROM d) + 1 ELSE x{m - 1} END AS p FROM w{m} WHERE k % {EVERY} = 0 AND x{m - 1} IS NOT NULL"
        parts.append(f"SELECT {m} AS m, CAST(o.p AS VARCHAR) AS p, coalesce(n, 0) AS brute, coalesce(n, 0) AS order1, coalesce(n, 0) AS plain FROM ({own}) o LEFT JOIN g{m} ON CAST(o.p AS VARCHAR) = g{m}.p")
    return _sql("ev", *every, " UNION ALL ".join(parts))


_add("bench_agree_ev", _agree, _agree_sql(range(1, 9)))


def _sampled(m: int) -> Query:
    def run(sp, d):
        s = _sequence("ev", sp, d)
        found = search.count(_built("ev", sp, d).index, cut(ngram.sample_patterns(s, m, 500)))
        return found.select("pid", "n_occ")

    return run


def _sampled_sql(m: int) -> str:
    word = f"array_to_string(list(id) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING), '-')"
    return _sql("ev", f"w AS (SELECT k, {word} AS p FROM t), q AS (SELECT pid, {draw_sql('pid', m)} % ((SELECT count(*) FROM t) - {m} + 1) AS k FROM (SELECT unnest(range(500)) AS pid)), g AS (SELECT p, count(*) AS n_occ FROM w WHERE k <= (SELECT max(k) FROM t) - {m} + 1 GROUP BY p)", "SELECT pid, n_occ FROM q JOIN w USING (k) JOIN g USING (p)")


for _m in (1, 8, 16, 32, 64):
    _add(f"sampled_patterns_ev_m{_m}", _sampled(_m), _sampled_sql(_m))


def _generated(sp, d):
    return generate(sp, *SYNTHETIC)


def _generated_sql() -> str:
    sigma, length, copies, mutation = SYNTHETIC
    salt = 10
    choice = " + ".join(f"({draw_sql('place', salt + CHOICE)} >= {x})::BIGINT" for x in thresholds())
    pos = f"(c.copy * {length} + b.place)"
    sym = f"CASE WHEN {draw_sql(pos, salt + WHERE)} < {int(mutation * PRIME)} THEN {draw_sql(pos, salt + WHAT)} % {sigma} ELSE b.sym END"
    return (
        f"WITH RECURSIVE b(place, sym) AS (SELECT n * {STRETCH}, {draw_sql(f'n * {STRETCH}', salt + START)} % {sigma} FROM (SELECT unnest(range({-(-length // STRETCH)})) AS n)"
        f" UNION ALL SELECT place + 1, {draw_sql(f'(sym * {FOLLOWERS} + {choice})', salt + FOLLOWER)} % {sigma} FROM b WHERE place + 1 < {length} AND (place + 1) % {STRETCH} <> 0)"
        f" SELECT {pos} AS pos, ({sym}) * {SPREAD} % {1 << 32} AS val FROM b, (SELECT unnest(range({copies})) AS copy) c"
    )


_add("generated_syn", _generated, _generated_sql())


def _scanned(width: int) -> Query:
    """lineitem's part keys written as flat files, and read back."""

    def run(sp, d):
        folder = f"{shared_dir(sp)}/ints-{uuid.uuid4().hex}"
        own = _sequence("li", sp, d)
        values = own.seq.join(own.dict, "id").select(F.col("k").alias("pos"), (F.col("val") % (1 << min(8 * width, 62))).alias("val"))
        save_ints(values, folder, width)
        return read_ints(sp, folder, width).select("pos", F.col("val").cast("long").alias("val"))

    return run


for _w in WIDTHS:
    _add(f"scan_ints_w{_w}_li", _scanned(_w), _sql("li", f"SELECT k AS pos, val % {1 << min(8 * _w, 62)} AS val FROM raw"))


def _stored(sp, d):
    """(line, n_occ): an index stored and loaded, patterns of raw values from a text file, counts to a text file and back."""
    folder = f"{shared_dir(sp)}/store-{uuid.uuid4().hex}"
    s = _sequence("li", sp, d)
    index.save(_built("li", sp, d), f"{folder}/index")
    loaded, words = index.load(sp, f"{folder}/index")
    pairs = stats.bigrams(s).join(s.dict.toDF("x", "a"), "a").join(s.dict.toDF("y", "b"), "b")
    pairs.orderBy("x", "y").select(F.concat_ws(" ", "x", F.col("y") + F.when(F.col("x") % 5 == 0, 10_000_000).otherwise(0)).alias("value")).coalesce(1).write.text(f"{folder}/patterns")
    write_counts(index.count_values(loaded, words, read_patterns(sp, f"{folder}/patterns")), f"{folder}/counts")
    back = sp.read.text(f"{folder}/counts").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return numbered(back, ["file", "block", "row"], "line")[0].select("line", F.col("value").cast("long").alias("n_occ"))


_add("stored_counts_li", _stored, _sql("li", _PAIRS, "v AS (SELECT x.val AS x, y.val AS y, cnt FROM big JOIN d x ON a = x.id JOIN d y ON b = y.id)", "SELECT row_number() OVER (ORDER BY x, y) - 1 AS line, CASE WHEN x % 5 = 0 THEN 0 ELSE cnt END AS n_occ FROM v"))
_add("id_of_ev", lambda sp, d: pattern_ids(sp.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("pid"), F.array("r_name").alias("p")).unionByName(_sequence("ev", sp, d).dict.select((F.col("id") + 100).cast("int").alias("pid"), F.array("val").alias("p"))), _sequence("ev", sp, d).dict).select("pid", F.col("p")[0].alias("id")), _sql("ev", "q AS (SELECT r_regionkey AS pid, r_name AS val FROM region UNION ALL SELECT id + 100, val FROM d)", "SELECT CAST(pid AS INTEGER) AS pid, coalesce(id, 0) AS id FROM q LEFT JOIN d USING (val)"))


def _ef(n: str, u: str) -> str:
    low = f"(CASE WHEN ({u}) // ({n}) > 1 THEN CAST(floor(log2(({u}) // ({n}))) AS BIGINT) ELSE 0 END)"
    high = f"(({n}) + (({u}) >> {low}) + 2)"
    return f"8 * ((({n}) * {low} + 63) // 64 + 1 + {high} // 64 + 2 + CAST(ceil(({n}) / 256.0) AS BIGINT) + CAST(ceil(({high} - ({n})) / 256.0) AS BIGINT)) + 40"


def _sizes_sql(form_expr: str) -> str:
    cnt = "v AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM d) AS sig, (SELECT count(*) FROM succ) AS nb, (SELECT max(rk) + 1 FROM succ) AS ke, (SELECT count(*) FROM (SELECT 1 FROM (SELECT i, l, lag(l) OVER (ORDER BY i) AS q FROM ls) WHERE q IS DISTINCT FROM l)) AS r, (SELECT count(*) FROM (SELECT 1 FROM (SELECT i, p, lag(p) OVER (ORDER BY i) AS q FROM ps) WHERE q IS DISTINCT FROM p)) AS rp)"
    return _sql("ev", _S, _SA_S, _BWT_S, _PSI, cnt, form_expr)


_add(
    "size_report_ev",
    lambda sp, d: index.size_report(_built("ev", sp, d)).where("form = 'order-1 elias-fano'").select("form", "bytes"),
    _sizes_sql(f"SELECT 'order-1 elias-fano' AS form, CAST(8 * sig + 8 * (sig + 2) + 8 * nb + 8 * (ke + 1) + {_ef('r', 'ke * n')} + {_ef('r', 'n')} + {_ef('rp', '(sig + 1) * n')} + {_ef('rp', 'n')} AS BIGINT) AS bytes FROM v"),
)
def _huffman_sql(name: str, counts: str) -> str:
    """name(cost): merges of the two smallest of a sorted list of counts (column f) until one is left."""
    return f"{name}_m(l, cost) AS (SELECT list(CAST(f AS BIGINT) ORDER BY f), CAST(0 AS BIGINT) FROM ({counts}) UNION ALL SELECT list_sort(list_append(l[3:], l[1] + l[2])), cost + l[1] + l[2] FROM {name}_m WHERE len(l) > 1), {name} AS (SELECT max(cost) AS cost FROM {name}_m)"


def _explicit_sql(n: str, runs_of: str, symbols: str) -> str:
    """Bytes of explicit run lists; a symbol of 64 runs or more has a jump table."""
    shift = f"(SELECT min(q) FROM (SELECT unnest(range(64)) AS q) WHERE ({n} >> q) <= f // 8)"
    jump = f"(SELECT coalesce(sum(CASE WHEN f >= 64 THEN ({n} >> CAST({shift} AS INT)) + 2 ELSE 0 END), 0) FROM {runs_of})"
    return f"16 * ({symbols} + 1) + 8 * ((SELECT sum(f) FROM {runs_of}) + {symbols}) + {symbols} + 4 * {jump}"


def _tree_sql(cost: str, symbols: str, distinct: str) -> str:
    return f"(72 * ({cost} // 512 + 1) + 9 * {symbols} + 8 * ({distinct} - 1) + 16 * {distinct})"


def _forms_sql() -> str:
    by = lambda name, table, c: f"{name} AS (SELECT c, count(*) AS f FROM (SELECT {c} AS c, lag({c}) OVER (ORDER BY i) AS q FROM {table}) WHERE q IS DISTINCT FROM c GROUP BY c)"
    closed = "lt AS (SELECT i, coalesce(t.id, 0) AS l FROM (SELECT r + 1 AS i, k FROM sa UNION ALL SELECT 0, (SELECT max(k) + 1 FROM t)) z LEFT JOIN t ON t.k = z.k - 1)"
    value = "v AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM d) AS sig, (SELECT count(*) FROM succ) AS nb, (SELECT max(rk) + 1 FROM succ) AS ke, (SELECT sum(f) FROM rb) AS r, (SELECT sum(f) FROM rp) AS p, (SELECT sum(f) FROM rt) AS q, (SELECT count(*) FROM rb) AS db, (SELECT count(*) FROM rt) AS dt, (SELECT cost FROM hb) AS hb, (SELECT cost FROM hbr) AS hbr, (SELECT cost FROM ht) AS ht, (SELECT cost FROM htr) AS htr)"
    shared, psi = "8 * sig + 8 * (sig + 2) + 8 * nb + 8 * (ke + 1)", f"{_ef('p', '(sig + 1) * n')} + {_ef('p', 'n')}"
    ef = lambda r, u: f"{_ef(r, u)}"
    rows = [
        ("order-1 explicit", f"{shared} + {_explicit_sql('n', 'rb', 'ke')} + {_explicit_sql('n', 'rp', '(sig + 1)')}", "hb / n"),
        ("order-1 elias-fano", f"{shared} + {ef('r', 'ke * n')} + {ef('r', 'n')} + {psi}", "hb / n"),
        ("order-1 huffman", f"{shared} + {_tree_sql('hb', 'ke', 'db')} + {psi}", "hb / n"),
        ("order-1 rl-huffman", f"{shared} + {_tree_sql('hbr', 'ke', 'db')} + {ef('r', 'n')} + {ef('r + 1', 'n + 1')} + 4 * (ke + 1) + {psi}", "hbr / r"),
        ("plain explicit", f"8 * (sig + 2) + {_explicit_sql('(n + 1)', 'rt', '(sig + 1)')}", "ht / (n + 1)"),
        ("plain elias-fano", f"8 * (sig + 2) + {ef('q', '(sig + 1) * (n + 1)')} + {ef('q', '(n + 1)')}", "ht / (n + 1)"),
        ("plain huffman", f"8 * (sig + 2) + {_tree_sql('ht', '(sig + 1)', 'dt')}", "ht / (n + 1)"),
        ("plain rl-huffman", f"8 * (sig + 2) + {_tree_sql('htr', '(sig + 1)', 'dt')} + {ef('q', '(n + 1)')} + {ef('q + 1', '(n + 2)')} + 4 * (sig + 2)", "htr / q"),
    ]
    forms = " UNION ALL ".join(f"SELECT '{name}' AS form, CAST({size} AS BIGINT) AS bytes, round({depth}, 6) AS depth FROM v" for name, size, depth in rows)
    parts = [_S, _SA_S, _BWT_S, _PSI, _SA, closed, by("rb", "ls", "l"), by("rp", "ps", "p"), by("rt", "lt", "l")]
    parts += [_huffman_sql("hb", "SELECT count(*) AS f FROM ls GROUP BY l"), _huffman_sql("hbr", "SELECT f FROM rb"), _huffman_sql("ht", "SELECT count(*) AS f FROM lt GROUP BY l"), _huffman_sql("htr", "SELECT f FROM rt"), value]
    return _sql("ev", *parts, f"SELECT form, bytes, depth, printf('%.2f MB', bytes / 1048576.0) AS shown FROM ({forms})").replace("WITH raw", "WITH RECURSIVE raw", 1)


_add("size_forms_ev", lambda sp, d: index.size_report(_built("ev", sp, d), _plain("ev", sp, d)).withColumn("depth", F.round("depth", 6)), _forms_sql())

_REPORT = _SUCC + ", c AS (SELECT count(*) AS c FROM t GROUP BY id), m AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM d) AS sigma, (SELECT count(*) FROM succ) AS nb, (SELECT max(rk) + 1 FROM succ) AS ke)"


def _run_count(table: str, c: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {c} AS c, lag({c}) OVER (ORDER BY i) AS q FROM {table}) WHERE q IS DISTINCT FROM c)"


_add(
    "bench_report_ev",
    lambda sp, d: index.bench_report(_built("ev", sp, d), _plain("ev", sp, d)).withColumn("value", F.round("value", 6)),
    _sql(
        "ev", _S, _SA_S, _BWT_S, _PSI, _SA, "lt AS (SELECT i, coalesce(t.id, 0) AS l FROM (SELECT r + 1 AS i, k FROM sa UNION ALL SELECT 0, (SELECT max(k) + 1 FROM t)) z LEFT JOIN t ON t.k = z.k - 1)", "c AS (SELECT count(*) AS c FROM t GROUP BY id)",
        "SELECT unnest(['n', 'sigma', 'h0', 'kE', 'bigrams', 'runs_bwt_s', 'runs_psi', 'runs_bwt_t']) AS metric, unnest([CAST((SELECT count(*) FROM t) AS DOUBLE), (SELECT count(*) FROM d), (SELECT round(sum(-(c / n) * log2(c / n)), 6) FROM c, (SELECT count(*) AS n FROM t)), (SELECT max(rk) + 1 FROM succ), (SELECT count(*) FROM succ), " + ", ".join((_run_count("ls", "l"), _run_count("ps", "p"), _run_count("lt", "l"))) + "]) AS value",
    ),
)
_add(
    "build_report_ev",
    lambda sp, d: index.build_report(_built("ev", sp, d)),
    _forms_sql().replace("SELECT form, bytes, depth, printf('%.2f MB', bytes / 1048576.0) AS shown FROM (", "SELECT v.n, v.sig AS sigma, v.ke AS \"kE\", CAST(v.r AS BIGINT) AS bwt_runs, CAST(v.p AS BIGINT) AS psi_runs, z.bytes FROM v, (", 1) + " z WHERE z.form = 'order-1 rl-huffman'",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pattern, n_occ): every distinct 3-gram of events counted through the order-1 index."""
    return _counted("ev", 3, "order1")(spark, sf_dir).select(F.col("p").alias("pattern"), "n_occ")


_add("count_order1_ev_m3", _counted("ev", 3, "order1"), _sql("ev", _gram_sql(3)))
