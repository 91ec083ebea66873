"""CRC-32 as SQL for the checks of queries that draw by it; Spark has it built in."""

# the table of the reflected polynomial, built from its rule
CRC_TABLE = (
    "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table"
)


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes; ``crc_table`` must be in scope."""
    each = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {each}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"
