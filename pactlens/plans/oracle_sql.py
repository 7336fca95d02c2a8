"""Building blocks for the oracle SQL (DuckDB).  Written by other means than the Spark side wherever that is possible:
rule tables with ``contains`` for patterns, plain windows for bucketed ranks, assembled texts for fragments."""

from __future__ import annotations

from pactlens import vocab
from pactlens.functions.rules import BASE, STRICT, RulePack

WS = vocab.SPACES
WS_LINE = WS.replace("\n", "")


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def noise_symbols(x: str) -> str:
    return f"regexp_replace({x}, '[{vocab.NOISE_SYMBOLS}]+', '', 'g')"


def placeholders(x: str) -> str:
    first = f"regexp_replace({x}, '_{{3,}}|…{{2,}}|\\\\[^' || chr(10) || ']{{3,}}|…_', '', 'g')"
    return f"regexp_replace({first}, 'X{{2,}}|x{{2,}}', '', 'g')"


def repeats(x: str) -> str:
    """One replacement per character: there is no backreference here."""
    for ch in vocab.COLLAPSING_PUNCTUATION + WS:
        x = f"regexp_replace({x}, '[{ch}]{{2,}}', '{ch}', 'g')"
    return x


def page_marks(line: str) -> str:
    s, d = f"[{WS_LINE}]*", "\\p{Nd}+"
    return f"regexp_replace({line}, '第{s}{d}{s}页{s}共{s}{d}{s}页|-{s}{d}{s}-|^{d}$', '', 'g')"


def squeeze(line: str) -> str:
    return strip(f"regexp_replace({line}, '[ \t\r\f\x0b]+', ' ', 'g')")


def short_noise(line: str) -> str:
    return f"regexp_matches({line}, '^[{WS}{vocab.PRIVATE_USE}]{{1,4}}$')"


def cleaned_lines(table: str, keys: str, text: str = "text") -> str:
    """``keys, n, line``: the lines that survive cleaning, numbered within their text."""
    whole = repeats(placeholders(noise_symbols(f"coalesce({text}, '')")))
    return (
        f"SELECT {keys}, n, line FROM (SELECT {keys}, n, {squeeze(page_marks('raw'))} AS line FROM "
        f"(SELECT {keys}, unnest(string_split(body, chr(10))) AS raw, "
        f"generate_subscripts(string_split(body, chr(10)), 1) AS n FROM (SELECT {keys}, {whole} AS body FROM {table}))) "
        f"WHERE line <> '' AND NOT {short_noise('line')}"
    )


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def values(rows: list[tuple], names: str) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS {names}"


def rule_rows(pack: RulePack) -> list[tuple]:
    rows = [(label, "positive", p) for label, ps in pack.positive.items() for p in ps]
    return rows + [(label, "negative", p) for label, ps in pack.negative.items() for p in ps]


def decided(texts: str, pack: RulePack) -> str:
    """``text, decision`` for every text of a one-column table, by a join with the rule table."""
    return f"""
      SELECT text, CASE WHEN bool_or(label = {pack.priority}) THEN '{pack.priority}' WHEN count(label) >= 2 THEN 'review'
             WHEN count(label) = 1 THEN CAST(max(label) AS VARCHAR) ELSE '0' END AS decision
      FROM (SELECT t.text, CASE WHEN bool_or(r.polarity = 'positive') AND NOT bool_or(r.polarity = 'negative') THEN r.label END AS label
            FROM {texts} t LEFT JOIN {values(rule_rows(pack), 'r(label, polarity, phrase)')} ON contains(t.text, r.phrase)
            GROUP BY t.text, r.label) GROUP BY text"""


def placeholder_count(x: str) -> str:
    return f"(length({x}) - length(translate({x}, '{vocab.PLACEHOLDER_CHARS}', '')))"


def strict_reason(x: str) -> str:
    low, high = STRICT.band
    return (
        f"CASE WHEN length({x}) < {low} OR length({x}) > {high} THEN 'length' "
        f"WHEN {placeholder_count(x)} > length({x}) * CAST({vocab.PLACEHOLDER_SHARE} AS DOUBLE) THEN 'placeholder' "
        f"WHEN {any_of(x, STRICT.sections)} THEN 'section' END"
    )


def base_scope(x: str) -> str:
    low, high = BASE.band
    twice = " OR ".join(
        f"(length({x}) - length(replace({x}, '{p}', ''))) / {len(p)} >= 2" for p in vocab.BASE_REPEATED_PLACEHOLDERS
    )
    return (
        f"CASE WHEN length({x}) NOT BETWEEN {low} AND {high} OR {any_of(x, BASE.sections)} "
        f"OR translate({x}, '{vocab.PLACEHOLDER_CHARS} ', '') = '' OR {twice} THEN 'discard' "
        f"WHEN {any_of(x, BASE.business)} THEN 'label' ELSE 'outside' END"
    )


def strict_labels(table: str) -> str:
    """``text, label`` for the distinct texts of a table."""
    return (
        f"SELECT d.text, CASE WHEN {strict_reason('d.text')} IS NOT NULL OR NOT {any_of('d.text', STRICT.business)} "
        f"THEN 'discard' ELSE decision END AS label FROM ({decided(f'(SELECT DISTINCT text FROM {table})', STRICT)}) d"
    )


def base_labels(table: str) -> str:
    return (
        f"SELECT d.text, CASE {base_scope('d.text')} WHEN 'discard' THEN 'discard' WHEN 'label' THEN decision END AS label "
        f"FROM ({decided(f'(SELECT DISTINCT text FROM {table})', BASE)}) d"
    )


def labels_dim() -> str:
    return values([*vocab.LABELS, vocab.REJECTED], "d(label_id, risk_type, risk_level)")


def tokens(x: str) -> str:
    """Words of a text with Han runs set apart; bigrams are made by the caller."""
    return (
        f"regexp_extract_all(regexp_replace(lower({x}), '([㐀-䶿一-鿿]+)', ' \\1 ', 'g'), "
        "'[\\p{L}\\p{N}_]+')"
    )


def token_rows(table: str, key: str, text: str = "text") -> str:
    """``key, n, k, token``: word n, and bigram k inside a Han word."""
    runs = tokens(text)
    return (
        f"SELECT {key}, n, k, CASE WHEN han THEN substr(run, k, 2) ELSE run END AS token FROM ("
        f"SELECT *, unnest(generate_series(1, CASE WHEN han THEN length(run) - 1 ELSE 1 END)) AS k FROM ("
        f"SELECT *, length(run) > 2 AND regexp_matches(run, '^[㐀-䶿一-鿿]') AS han FROM ("
        f"SELECT {key}, unnest({runs}) AS run, generate_subscripts({runs}, 1) AS n FROM {table})))"
    )


def gram_rows(table: str, key: str, text: str = "text") -> str:
    """``key, term``: every occurrence of a one- or two-word term."""
    return (
        f"SELECT {key}, unnest([token, token || ' ' || following]) AS term FROM (SELECT {key}, token, "
        f"lead(token) OVER (PARTITION BY {key} ORDER BY n, k) AS following FROM "
        f"({token_rows(table, key, text)}) WHERE length(token) >= 2)"
    )
