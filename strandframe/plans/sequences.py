"""Section C: sequence functions over the reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions.align import needleman_wunsch
from ..operators.tokens import pad_tokens, tokenize
from .registry import query
from .sql import canon, code, decode, flip, kmer_list

BIG = "bigint"
CODES12 = f"list_transform(list_filter({kmer_list('read', 12, 1, None)}, lambda w: NOT regexp_matches(w, '[^ACGT]')), lambda w: {code('w', 12)})"


@query(
    "c1_kmer_to_int",
    f"""SELECT read_id, CAST(len(c) AS BIGINT) AS n, CAST(list_sum(c) AS BIGINT) AS total, c[1] AS first, c[-1] AS last
    FROM (SELECT read_id, {CODES12} AS c FROM reads) WHERE len(c) > 0""",
)
def _(fx):
    codes = F.filter(S.kmers_to_int(S.kmers("read", 12, 1, strand=None)), F.isnotnull)
    c = fx.reads.select("read_id", codes.alias("c")).filter(F.size("c") > 0)
    total = F.aggregate("c", F.lit(0).cast(BIG), lambda a, x: a + x)
    return c.select("read_id", F.size("c").cast(BIG).alias("n"), total.alias("total"), F.get("c", F.lit(0)).alias("first"), F.element_at("c", -1).alias("last"))


@query(
    "c2_int_to_kmer",
    f"""SELECT CAST(o_orderkey AS BIGINT) AS code, {decode('o_orderkey', 13)} AS kmer,
    CAST(o_orderkey AS BIGINT) AS back FROM orders""",
)
def _(fx):
    o = fx.table("orders").select(F.col("o_orderkey").cast(BIG).alias("code"), S.int_to_kmer("o_orderkey", 13).alias("kmer"))
    return o.withColumn("back", S.kmer_to_int("kmer"))


@query(
    "c3_complement",
    f"SELECT read_id, {flip('read')} AS comp, {canon('read', 'complement')} AS comp_not_ac FROM reads",
)
def _(fx):
    return fx.reads.select(
        "read_id", S.complement("read").alias("comp"), S.complement("read", not_ac=True).alias("comp_not_ac")
    )


@query("c4_reverse_complement", f"SELECT read_id, reverse({flip('read')}) AS revcomp FROM reads")
def _(fx):
    return fx.reads.select("read_id", S.reverse_complement("read").alias("revcomp"))


@query("c5_canonical_kmer", f"SELECT read_id, array_to_string({kmer_list('read', 6)}, ',') AS canonical FROM reads")
def _(fx):
    words = F.transform(S.kmers("read", 6, 1, strand=None), lambda w: S.canonical(w))
    return fx.reads.select("read_id", F.array_join(words, ",").alias("canonical"))


@query(
    "c6_kmers",
    f"""SELECT read_id, array_to_string({kmer_list('read', 5, 2)}, ',') AS words,
    array_to_string({kmer_list('read', 5, 3, None)}, ',') AS plain_words,
    CAST(len({kmer_list('read', 5, 2)}) AS BIGINT) AS n FROM reads""",
)
def _(fx):
    return fx.reads.select(
        "read_id",
        F.array_join(S.kmers("read", 5, 2), ",").alias("words"),
        F.array_join(S.kmers("read", 5, 3, strand=None), ",").alias("plain_words"),
        F.size(S.kmers("read", 5, 2)).cast(BIG).alias("n"),
    )


@query(
    "c7_kmers_known",
    f"""SELECT read_id, array_to_string(list_filter({kmer_list('read', 7, 2)},
    lambda w: NOT regexp_matches(w, '[^ACGT]')), ',') AS words FROM reads""",
)
def _(fx):
    return fx.reads.select("read_id", F.array_join(S.kmers("read", 7, 2, remove_unk=True), ",").alias("words"))


@query(
    "c8_kmer_sentence",
    f"SELECT read_id, array_to_string({kmer_list('substr(read, 1, 20)', 6)}, ' ') AS sentence FROM reads",
)
def _(fx):
    return fx.reads.select("read_id", S.kmer_sentence("read", 6, 20).alias("sentence"))


def _unk_sql(read: str, k: int, s: int) -> str:
    words = f"list_transform({kmer_list(read, k, s)}, lambda w: CASE WHEN regexp_matches(w, '[^ACGT]') THEN '<unk>' ELSE w END)"
    return f"regexp_replace(array_to_string({words}, ' '), '<unk>( <unk>)+', '<unk>', 'g')"


@query(
    "c9_kmer_sentence_unk",
    f"""SELECT read_id, {_unk_sql('read', 7, 1)} AS whole,
    {_unk_sql('substr(read, 1, CAST(length(read) - length(read) % 7 AS INT))', 7, 3)} AS begin_mode,
    {_unk_sql('substr(read, CAST(length(read) % 7 + 1 AS INT))', 7, 3)} AS end_mode,
    array_to_string(list_filter({kmer_list('read', 7, 1)}, lambda w: NOT regexp_matches(w, '[^ACGT]')), ' ') AS known
    FROM reads""",
)
def _(fx):
    return fx.reads.select(
        "read_id",
        S.kmer_sentence_unk("read", 7).alias("whole"),
        S.kmer_sentence_unk("read", 7, 3, "b").alias("begin_mode"),
        S.kmer_sentence_unk("read", 7, 3, "e").alias("end_mode"),
        S.kmer_sentence_unk("read", 7, remove_unk=True).alias("known"),
    )


TOKEN_ROWS = f"""hits AS (
  SELECT read_id, pos, id FROM (
    SELECT read_id, pos, {canon('w', 'complement')} AS word FROM (
      SELECT read_id, pos, substr(read, pos, 5) AS w FROM (
        SELECT read_id, read, unnest(range(1, length(read) - 3)) AS pos FROM reads)))
  LEFT JOIN kmer_vectors ON kmer = word),
kept AS (
  SELECT read_id, pos, coalesce(id, -1) AS id FROM (
    SELECT *, lag(id) OVER w AS before, row_number() OVER w AS rn FROM hits WINDOW w AS (PARTITION BY read_id ORDER BY pos))
  WHERE id IS NOT NULL OR rn = 1 OR before IS NOT NULL),
lists AS (SELECT read_id, list(id ORDER BY pos) AS ids FROM kept GROUP BY read_id)"""


@query(
    "c10_tokenize",
    f"WITH {TOKEN_ROWS} SELECT reads.read_id, coalesce(array_to_string(ids, ','), '') AS tokens FROM reads LEFT JOIN lists USING (read_id)",
)
def _(fx):
    t = tokenize(fx.reads, fx.kmer_vectors, 5)
    return t.select("read_id", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@query(
    "c11_tokenize_batch",
    f"""WITH {TOKEN_ROWS}, sizes AS (SELECT max(len(ids)) AS longest FROM lists)
    SELECT reads.read_id, array_to_string(list_concat(coalesce(ids, []), list_resize(CAST([] AS INT[]),
      CAST(longest - len(coalesce(ids, [])) AS BIGINT), -2)), ',') AS tokens,
      CAST(longest AS BIGINT) AS n
    FROM reads LEFT JOIN lists USING (read_id), sizes""",
)
def _(fx):
    t = pad_tokens(tokenize(fx.reads, fx.kmer_vectors, 5))
    return t.select(
        "read_id",
        F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"),
        F.size("tokens").cast(BIG).alias("n"),
    )


@query(
    "c12_gc_rate",
    "SELECT read_id, round(length(regexp_replace(read, '[^CG]', '', 'g')) / length(read), 9) AS gc FROM reads",
)
def _(fx):
    return fx.reads.select("read_id", F.round(S.gc_rate("read"), 9).alias("gc"))


@query(
    "c13_acgt_length",
    "SELECT genome_id, CAST(length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS BIGINT) AS bp_length FROM genome",
)
def _(fx):
    return fx.genome.select("genome_id", S.acgt_length("seq").cast(BIG).alias("bp_length"))


@query(
    "c14_fragment",
    """SELECT genome_id, CAST(i AS BIGINT) AS piece_no, substr(clean, i * 20 + 1, 20) AS piece FROM (
      SELECT genome_id, clean, unnest(range(0, length(clean) // 20)) AS i FROM (
        SELECT genome_id, regexp_replace(seq, 'NN+', '', 'g') AS clean FROM genome))""",
)
def _(fx):
    pieces = fx.genome.select("genome_id", F.posexplode(S.fragments("seq", 20)).alias("piece_no", "piece"))
    return pieces.withColumn("piece_no", F.col("piece_no").cast(BIG))


@query(
    "c15_hamming",
    """SELECT m1.read_id, CAST(hamming(m1.read, m2.read) AS BIGINT) AS distance FROM reads m1 JOIN reads m2
    ON m2.read_id = regexp_replace(m1.read_id, '/1$', '/2') WHERE m1.read_id LIKE '%/1'""",
)
def _(fx):
    return _mates(fx).select("read_id", S.hamming("a", "b").cast(BIG).alias("distance"))


def _mates(fx):
    """(read_id of mate 1, a, b): the two mates of every fragment."""
    return fx.fragment.select(
        F.concat("frag_id", F.lit("/1")).alias("read_id"),
        F.substr(F.col("bases"), F.lit(1), F.lit(60)).alias("a"),
        S.reverse_complement(F.substr(F.col("bases"), F.lit(61), F.lit(60))).alias("b"),
    )


# fixed values: match +1, mismatch -1, gap -1
DIAGONAL = """list_transform(range(0, length(a) + 1), lambda i: CASE WHEN i = 0 OR i = d + 1 THEN -(d + 1) WHEN i > d OR d + 1 - i > length(b) THEN NULL
      ELSE greatest(p2[i] + CASE WHEN a[i] = b[d + 1 - i] THEN 1 ELSE -1 END, greatest(p1[i], p1[i + 1]) - 1) END)"""


def needle_sql(pairs: str) -> str:
    """(a, b, score) of the distinct rows (a, b) of ``pairs``, by diagonals of the score matrix."""
    return f"""SELECT a, b, CAST(p1[length(a) + 1] AS BIGINT) AS score FROM (
      WITH RECURSIVE dp(a, b, d, p2, p1) AS (
        SELECT a, b, 0, CAST([0] AS INT[]), CAST([0] AS INT[]) FROM (SELECT DISTINCT a, b FROM ({pairs}))
        UNION ALL SELECT a, b, d + 1, p1, CAST({DIAGONAL} AS INT[]) FROM dp WHERE d < length(a) + length(b))
      SELECT a, b, p1 FROM dp WHERE d = length(a) + length(b))"""


MATES = f"SELECT concat(frag_id, '/1') AS read_id, substr(bases, 1, 60) AS a, reverse({flip('substr(bases, 61, 60)')}) AS b FROM fragment"


@query("c16_needleman_wunsch", f"SELECT m.read_id, s.score FROM ({MATES}) m JOIN ({needle_sql(MATES)}) s ON m.a = s.a AND m.b = s.b")
def _(fx):
    return aligned(_mates(fx))


def aligned(pairs):
    """Score of every pair where it is: it costs less than to look for equal ones."""
    return pairs.where("a IS NOT NULL AND b IS NOT NULL").select("read_id", needleman_wunsch("a", "b").alias("score"))


@query(
    "c17_orient_pair",
    f"""SELECT read_id, CASE WHEN f THEN substr(r, 1, 25) ELSE substr(x, 1, 25) END AS a,
      CASE WHEN f THEN substr(r, 26) ELSE substr(x, 26) END AS b FROM (
        SELECT read_id, x, reverse({flip('x')}) AS r, x[1] IN ('G', 'T') AND x[-1] IN ('G', 'T') AS f FROM (
          SELECT read_id, read AS x FROM reads))""",
)
def _(fx):
    p = S.orient_pair(F.substr("read", F.lit(1), F.lit(25)), F.substr("read", F.lit(26)))
    return fx.reads.select("read_id", p.alias("p")).select("read_id", "p.a", "p.b")
