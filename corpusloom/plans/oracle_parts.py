"""SQL pieces shared by the oracle queries (DuckDB dialect)."""

# Pre-tokens without look-ahead or possessive repeats: the last white-space character of a run that
# precedes other text is marked with U+E000, matched, and unmarked again.
_MARK = "\ue000"
_PATTERN = (
    "''(?i:[sdmt]|ll|ve|re)|M?[^\\r\\n\\p{L}\\p{N}M]?\\p{L}+|\\p{N}{1,2}|M? ?[^\\s\\p{L}\\p{N}M]+[\\r\\n]*"
    "|\\s*M?[\\r\\n]|\\s+|M\\s"
).replace("M", _MARK)


def pieces(text: str) -> str:
    marked = f"regexp_replace({text}, '(\\s)(\\s\\S)', '\\1{_MARK}\\2', 'g')"
    return f"list_transform(regexp_extract_all({marked}, '{_PATTERN}'), lambda p: replace(p, '{_MARK}', ''))"


def byte_list(text: str) -> str:
    """UTF-8 bytes as a list of integers."""
    return f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::INT)"


def joined(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


# Documents with their byte-token counts and positions; source is the shard.
OFFSETS = """
lens as (select source as shard, doc_id, strlen(text) + 1 as n, text from documents),
offsets as (
  select shard, doc_id, n, text,
    row_number() over (partition by shard order by doc_id) - 1 as ord,
    (sum(n) over (partition by shard order by doc_id) - n)::bigint as shard_pos,
    (sum(n) over (order by shard, doc_id) - n)::bigint as start_pos
  from lens)
"""
