"""The CRC-32 of a number's decimal text as DuckDB SQL, for the oracles."""


def crc32_sql(value: str) -> str:
    """An expression for the unsigned CRC-32 of ``value`` written in decimal; null for null."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT))"
    text = f"list_transform(string_split({value}::VARCHAR, ''), lambda t: ascii(t)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {text}), lambda c, b: {bits}), 4294967295::BIGINT)"
