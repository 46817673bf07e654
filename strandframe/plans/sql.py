"""SQL text pieces shared by the statements (DuckDB dialect)."""

from __future__ import annotations


def flip(x: str) -> str:
    return f"translate({x}, 'ACGTURYKMSWBDHVN', 'TGCAAYRMKSWVHDBN')"


def canon(x: str, strand: str = "revcomp") -> str:
    flipped = f"reverse({flip(x)})" if strand == "revcomp" else flip(x)
    return f"CASE WHEN substr({x}, 1, 1) IN ('A', 'C') THEN {x} ELSE {flipped} END"


def code(x: str, k: int) -> str:
    return "CAST(" + " + ".join(
        f"CAST(instr('ACGT', substr({x}, {i + 1}, 1)) - 1 AS BIGINT) * {4**i}" for i in range(k)
    ) + " AS BIGINT)"


def decode(n: str, k: int) -> str:
    return "concat(" + ", ".join(
        f"substr('ACGT', CAST(1 + (({n} // {4**i}) % 4) AS INT), 1)" for i in range(k)
    ) + ")"


def kmer_list(read: str, k: int, s: int = 1, strand: str | None = "revcomp") -> str:
    """List of canonical k-mers of a read."""
    sub = f"substr({read}, i + 1, {k})"
    word = sub if strand is None else canon(sub, strand)
    return f"list_transform(range(0, greatest(length({read}) - {k - 1}, 0), {s}), lambda i: {word})"


def kmer_rows(k: int, cols: str = "read_id, sample_id", s: int = 1, source: str = "reads", strand: str = "revcomp") -> str:
    """Rows of unambiguous canonical k-mers with their 1-based start."""
    return f"""SELECT {cols}, pos, {canon('w', strand)} AS kmer FROM (
      SELECT {cols}, pos, substr(read, pos, {k}) AS w FROM (
        SELECT {cols}, read, unnest(range(1, length(read) - {k - 2}, {s})) AS pos FROM {source} WHERE length(read) >= {k}))
    WHERE NOT regexp_matches(w, '[^ACGT]')"""


def md5_key(seed: int | str, *keys: str) -> str:
    return f"md5(concat_ws('-', {', '.join(keys)}, '{seed}'))"
