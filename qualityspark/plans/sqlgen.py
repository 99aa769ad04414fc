"""Small helpers to write the oracle SQL (DuckDB dialect) for the catalog."""

from __future__ import annotations


def unpivot(table: str, columns, ids=(), feature="feature", value="value") -> str:
    """UNION ALL form of an unpivot (portable across engines)."""
    id_sql = "".join(f"{i}, " for i in ids)
    parts = [f"SELECT {id_sql}'{c}' AS {feature}, CAST({c} AS DOUBLE) AS {value} FROM {table}"
             for c in columns]
    return "\nUNION ALL ".join(parts)


def r6(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"


def clip_sql(col: str, lo: str, hi: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN NULL WHEN {lo} IS NOT NULL AND {col} < {lo} THEN {lo} "
            f"WHEN {hi} IS NOT NULL AND {col} > {hi} THEN {hi} ELSE {col} END")


def t_two_sided_sql(t: str, df: str) -> str:
    """Twin of ``functions.numeric.t_two_sided`` for a finite statistic (NULL if it is)."""
    step = "exp(pi() / 2 * (exp(i / 32.0) - exp(-i / 32.0)) / 2)"
    cosh = "((exp(i / 32.0) + exp(-i / 32.0)) / 2)"

    def beyond(start):
        s = f"({start} + {step})"
        return f"list_sum([{step} * {cosh} * exp(-({df} + 1) / 2 * ln(1 + {s} * {s} / {df})) FOR i IN range(-128, 129)])"

    return f"CASE WHEN {t} IS NOT NULL THEN {beyond(f'abs({t})')} / {beyond('0')} END"
