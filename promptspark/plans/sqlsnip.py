"""DuckDB SQL fragments shared by the oracle queries (kept tiny on purpose:
the oracle is written independently of the Spark operators)."""

# ceil(code points / 4) as BIGINT
def tok(expr: str) -> str:
    return f"CAST(ceil(length({expr})::DOUBLE / 4.0) AS BIGINT)"


def r6(expr: str) -> str:
    return f"round(({expr})::DOUBLE, 6)"


# P8 normal form (lines trimmed, empty lines dropped, lower-cased)
def norm_content(expr: str) -> str:
    return (f"lower(array_to_string(list_filter(list_transform(string_split({expr}, chr(10)), "
            f"lambda l: trim(l)), lambda l: l <> ''), chr(10)))")


# P9 normal form
def norm_text(expr: str) -> str:
    return f"lower(trim(regexp_replace({expr}, '\\s+', ' ', 'g')))"
