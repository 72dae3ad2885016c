"""The DuckDB statement of op12: damage, faults, and the cheapest repair as a fold over each conversation's rows.

The fold carries, for each of the grammar's four states, the cheapest way to it so far:
its cost, its audit (of equal costs the least one, which any continuation keeps least)
and its turns.  Lists count from 1.
"""

from __future__ import annotations


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _way(cost: str, audit: str, turns: str) -> str:
    return f"{{'c': {cost}, 'a': {audit}, 'o': {turns}}}"


_NONE = _way("CAST(1000000000 AS BIGINT)", "''", "[]::VARCHAR[]")
_START = _way("CAST(0 AS BIGINT)", "''", "[]::VARCHAR[]")


def _inserted(way: str, role: str) -> str:
    return _way(f"{way}.c + 2", f"{way}.a || 'I'", f"list_append({way}.o, '{role}:')")


def _deleted(way: str) -> str:
    return _way(f"{way}.c + 3", f"{way}.a || 'D'", f"{way}.o")


def _kept(way: str) -> str:
    return _way(f"{way}.c + x.t", f"{way}.a || 'K'", f"list_append({way}.o, x.role || ':' || x.text)")


def _reroled(way: str, role: str) -> str:
    return _way(f"{way}.c + 2 + x.t", f"{way}.a || 'R'", f"list_append({way}.o, '{role}:' || x.text)")


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _if(condition: str, way: str) -> str:
    return f"CASE WHEN {condition} THEN {way} ELSE {_NONE} END"


def _with_insertions(ways: str, body: str) -> str:
    """body over z: the four ways after insertions."""
    asked = _least(f"{ways}[3]", *[_inserted(f"{ways}[{q}]", "user") for q in (1, 2, 4)])
    return _let("y", asked, _let("z", f"[{ways}[1], {ways}[2], y, {_least(f'{ways}[4]', _inserted('y', 'assistant'))}]", body))


def _step() -> str:
    """The ways after one more row x."""
    users = [_if("NOT x.must AND x.r = 'u'", _kept(f"z[{q}]")) for q in (1, 2, 4)] + [_if("NOT x.must", _reroled(f"z[{q}]", "user")) for q in (1, 2, 4)]
    after = [
        _deleted("z[1]"),
        _least(_deleted("z[2]"), _if("NOT x.must AND x.r = 's'", _kept("z[1]"))),
        _least(_deleted("z[3]"), *users),
        _least(_deleted("z[4]"), _if("NOT x.must AND x.r = 'a'", _kept("z[3]")), _if("NOT x.must", _reroled("z[3]", "assistant"))),
    ]
    return _with_insertions("acc.s", f"[{', '.join(after)}]")


#: CRC-32 bit by bit (fixed values: the polynomial and the start).
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda ch: CAST(unicode(ch) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, e: xor(d >> 1, 3988292384 * (d & 1)))), CAST(4294967295 AS BIGINT))"
_FIRST = f"{{'must': false, 't': CAST(0 AS BIGINT), 'r': '', 'role': '', 'text': '', 's': [{_START}, {_NONE}, {_NONE}, {_NONE}]}}"
_FOLD = f"list_reduce(list_prepend({_FIRST}, rows), lambda acc, x: {{'must': x.must, 't': x.t, 'r': x.r, 'role': x.role, 'text': x.text, 's': {_step()}}}).s"

STATEMENT = f"""
    WITH keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    fated AS (SELECT *, {_CRC} % 20 AS fate FROM keyed),
    damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS n FROM fated),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), n) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends FROM damaged),
    judged AS (SELECT *, ends = '' AS blank, ends <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
    marked AS (SELECT *, NOT blank AND NOT again AND right(ends, 1) NOT IN ('.', '!', '?') AS cut FROM judged),
    gathered AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list({{'must': blank OR again, 't': CAST(cut AS BIGINT), 'r': r, 'role': role, 'text': text, 's': []::STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])[]}} ORDER BY i) AS rows FROM marked GROUP BY 1),
    walked AS (SELECT * EXCLUDE (rows), {_FOLD} AS s FROM gathered),
    best AS (SELECT * EXCLUDE (s), {_with_insertions('s', _least('z[1]', 'z[4]'))} AS b FROM walked)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""
