"""SQL of the text functions, written for the engine that checks the queries."""

from __future__ import annotations

from tessera.functions import text as T


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def array(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def contains_any(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(p)})" for p in parts) + ")"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[A-Za-z0-9_\-./]+')"


def collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def variants(x: str) -> str:
    each = r"flatten([[t, regexp_replace(t, '[-/.]', '', 'g')] || CASE WHEN regexp_matches(t, '\d') THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(t, '[-/.]') END" + f" for t in {x}])"
    return f"list_sort(list_distinct(list_filter({each}, lambda v: v <> '')))"


def eval_tokens(x: str) -> str:
    return rf"list_filter([regexp_replace(t, '^[.,;:]+|[.,;:]+$', '', 'g') for t in regexp_extract_all(lower({x}), '[a-zA-Z0-9][a-zA-Z0-9\-/.]+')], lambda t: t <> '')"


def first_distinct(x: str) -> str:
    """Distinct values in the order of their first places."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def specific(t: str) -> str:
    shaped = " OR ".join(like(t, p) for p in (r"^[a-z]{2,}\d+[a-z0-9-]*$", T.MEASURE_TOKEN, r"^[a-z]+(?:/[a-z0-9-]+)+$", r"^[a-z]+-[a-z0-9-]+$"))
    return rf"({t} NOT IN {listed(T.EVAL_STOPWORDS + T.GENERIC_ANCHORS)} AND ((length({t}) >= 3 AND regexp_matches({t}, '\d')) OR {t} IN {listed(T.TECHNICAL_TERMS + T.TECHNICAL_VERBS)} OR {shaped} OR length({t}) >= 5))"


def high_signal(t: str) -> str:
    return rf"(regexp_matches({t}, '\d') OR {t} IN {listed(T.TECHNICAL_TERMS + T.TECHNICAL_VERBS)} OR regexp_matches({t}, '[\[/-]'))"


def anchors(x: str, limit: int = 6) -> str:
    found = f"list_filter({eval_tokens(x)}, lambda t: {specific('t')})"
    return f"list_slice({first_distinct(found)}, 1, {limit})"


def keywords(x: str) -> str:
    forms = f"flatten([[m, lower(m), replace(m, '-', ''), lower(replace(m, '-', ' '))] for m in regexp_extract_all({x}, {quoted(T.CODES)})])"
    return f"list_slice(list_sort(list_distinct(list_filter([trim(v) for v in {forms} || regexp_extract_all({x}, {quoted(T.MENU)})], lambda v: v <> ''))), 1, 40)"


def unwanted(x: str) -> str:
    low = f"lower({x})"
    return "(" + " OR ".join([like(low, T.URL), like(low, T.PAGE_MARK), like(low, T.PHONE_WORD), like(low, T.ASSET + r"\b"), like(x, T.PHONE)]) + ")"


def low_information(x: str, kind: str, known: str) -> str:
    lettered = f"len(list_filter({words(f'trim({x})')}, lambda w: regexp_matches(w, '[A-Za-zÀ-ɏ]')))"
    n = f"len({words(f'trim({x})')})"
    few = rf"(({n} <= 2 AND NOT regexp_matches({x}, '\d') AND NOT {known}) OR ({n} <= 3 AND {lettered} <= 1))"
    return f"(trim({x}) = '' OR ({kind} <> 'table' AND ({unwanted(f'trim({x})')} OR ({kind} <> 'spec' AND {few}))))"


def completeness(x: str, kind: str | None = None) -> str:
    n, value = f"len({words(f'trim({x})')})", like(f"lower({x})", T.VALUE)
    structured = f" + CASE WHEN {kind} IN ('spec_record', 'table_record', 'procedure_record') THEN 0.15 ELSE 0 END" if kind else ""
    return (
        f"CAST(CASE WHEN {n} >= 8 THEN 0.35 WHEN {n} >= 5 THEN 0.15 ELSE 0 END + CASE WHEN {value} THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches({x}, '[0-9]') THEN 0.1 ELSE 0 END"
        f" + CASE WHEN regexp_matches({x}, '[.;:]') THEN 0.1 ELSE 0 END{structured} - CASE WHEN {n} <= 6 AND NOT {value} AND NOT {like(f'lower({x})', T.VERBS)} THEN 0.4 ELSE 0 END - CASE WHEN {n} <= 3 THEN 0.25 ELSE 0 END AS DOUBLE)"
    )
