"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations

from ledgerline.functions import lexicon as L


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(words: list[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), {quoted(L.TOKEN)}), lambda t: length(t) >= {L.MIN_TOKEN} AND NOT list_contains({array(L.STOPWORDS)}, t))"


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'), ' ')"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


def first_tag(x: str, families: list[tuple[str, list[str]]]) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(f'lower({x})', words)} THEN {quoted(name)}" for name, words in families) + " END"


def result_type(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {matches(f'lower({x})', p)} THEN {quoted(n)}" for n, p in L.RESULT_TYPES) + " END"


def outcome(x: str) -> str:
    verb = f"list_has_any(regexp_extract_all(lower({x}), '[a-z-]+'), {array(L.OUTCOME_VERBS)})"
    return f"(({result_type(x)}) IS NOT NULL OR ({matches(x, L.METRIC)} AND {verb}) OR ({any_of(f'lower({x})', L.QUALITATIVE)} AND NOT {matches(x, L.METRIC)}))"


def role(x: str) -> str:
    """Of statements without labels."""
    work = f"lower(regexp_extract({x}, '^[A-Za-z-]+')) IN ({', '.join(map(quoted, [*L.WORK_VERBS, *L.OUTCOME_VERBS]))})"
    problem = f"(({first_tag(x, L.COSTS)}) IS NOT NULL OR ({first_tag(x, L.INEFFICIENCIES)}) IS NOT NULL)"
    return f"CASE WHEN {outcome(x)} THEN 'outcome' WHEN {work} THEN 'work' WHEN {problem} THEN 'problem' ELSE 'ignored' END"


def statements(table: str, key: str, text: str) -> str:
    """(key, line_no, part_no, statement) of texts without bullets, headers and labels."""
    return f"""
    SELECT {key}, line_no, generate_subscripts(parts, 1) - 1 AS part_no, trim(unnest(parts), ' ') AS statement
    FROM (
      SELECT {key}, line_no, string_split(regexp_replace(line, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts
      FROM (SELECT {key}, unnest(string_split({text}, chr(10))) AS raw, generate_subscripts(string_split({text}, chr(10)), 1) - 1 AS line_no FROM {table}) r,
      LATERAL (SELECT trim(raw, ' ') AS line) l
      WHERE line <> '' AND NOT starts_with(line, '#')
    )
    """
