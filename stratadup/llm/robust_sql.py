"""The robust rules as one SQL statement for DuckDB, to check the DataFrame version."""

from __future__ import annotations

from stratadup.llm.robust_rules import COVARIANCES, FACTOR, MEANS, PAIRS, VECTOR, D, Rules

NAMES = ", ".join(MEANS + COVARIANCES)


def _distance() -> str:
    z: list[str] = []
    for i, name in enumerate(VECTOR):
        v = f"({name} - m{i})"
        for k in range(i):
            v = f"({v} - l{i}{k} * {z[k]})"
        z.append(f"({v} / l{i}{i})")
    return " + ".join(f"{x} * {x}" for x in z)


def _factored(body: str, rules: Rules) -> str:
    """One nested select per entry of the factor, as each needs the ones before."""
    for i, j in PAIRS:
        cov = f"(c{i}{j} + {rules.floor[i] if i == j else 0.0!r})"
        for k in range(j):
            cov = f"({cov} - l{i}{k} * l{j}{k})"
        body = f"select *, {f'sqrt({cov})' if i == j else f'{cov} / l{j}{j}'} as l{i}{j} from ({body})"
    return f"select pool, start, {NAMES}, {', '.join(FACTOR)}, {' * '.join(f'l{i}{i}' for i in D)} as root from ({body})"


_SUMS = ", ".join(["count(*) as n"] + [f"sum({v})::hugeint as s{i}" for i, v in enumerate(VECTOR)] + [f"sum({VECTOR[i]} * {VECTOR[j]})::hugeint as q{i}{j}" for i, j in PAIRS])


def _estimated(moments: str, prior: str, rules: Rules) -> str:
    means = ", ".join(f"s{i}::double / n::double as m{i}" for i in D)
    cov = ", ".join(f"(n::hugeint * q{i}{j} - s{i} * s{j})::double / n::double / n::double as c{i}{j}" for i, j in PAIRS)
    body = f"select pool, start, n, {means}, {cov} from ({moments})"
    if prior:
        shrunk = ", ".join(f"(n::double * x.{c} + {rules.prior!r} * y.{c}) / (n::double + {rules.prior!r}) as {c}" for c in MEANS + COVARIANCES)
        body = f"select x.pool, start, {shrunk} from ({body}) x join {prior} y using (pool)"
    return _factored(body, rules)


def _starts(t: str, prior: str, rules: Rules) -> str:
    quartiles = ", ".join(f"quantile_cont({v}::double, [0.25, 0.5, 0.75]) as p{i}" for i, v in enumerate(VECTOR))
    scale = lambda i: f"((p{i}[3] - p{i}[1]) / 1.349)"
    columns = [f"p{i}[2] as m{i}" for i in D] + [f"{scale(i)} * {scale(i)} as c{i}{j}" if i == j else f"0.0::double as c{i}{j}" for i, j in PAIRS]
    medians = _factored(f"select pool, 0 as start, {', '.join(columns)} from (select pool, {quartiles} from {t} group by pool)", rules)
    residue = f"((v_length + 3 * v_symbol + 5 * v_line + 7 * v_repeat) % {rules.parts}) + 1"
    return f"{medians} union all by name {_estimated(f'select pool, {residue} as start, {_SUMS} from {t} group by all', prior, rules)}"


def _step(t: str, e: str, k: int, prior: str, rules: Rules) -> str:
    body = _estimated(f"select pool, start, {_SUMS} from {e}_c{k} join {e}_x{k} using (pool, start) where cell <= edge group by pool, start", prior, rules)
    return f"""
    {e}_c{k} as materialized (select {t}.*, start, floor(ln({_distance()} + 0.001) * {rules.grid})::bigint as cell from {t} join {e}{k} using (pool)),
    {e}_r{k} as (select pool, start, cell, sum(c) over (partition by pool, start order by cell) as run, sum(c) over (partition by pool, start) as whole from (select pool, start, cell, count(*) as c from {e}_c{k} group by all)),
    {e}_x{k} as (select pool, start, min(cell) as edge from {e}_r{k} where run >= ceil({rules.core}::double * whole) group by pool, start),
    {e}_n{k + 1} as materialized ({body}),
    {e}{k + 1} as materialized (select * from {e}_n{k + 1}{" qualify row_number() over (partition by pool order by root, start) = 1" if k + 1 == rules.trial else ""})"""


def _determinant(t: str, e: str, prior: str, rules: Rules) -> str:
    return f"{e}0 as materialized ({_starts(t, prior, rules)})," + ",".join(_step(t, e, k, prior, rules) for k in range(rules.steps))


def statement(rules: Rules = Rules()) -> str:
    return f"""
with w as (select doc_id, coalesce('=' || lang, 'null') as l, coalesce('=' || source, 'null') as s, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
triples as (select doc_id, i, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] as g from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) > 2)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from triples) where c > 1),
repeats as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as k from again) group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from w),
dups as (select doc_id, count(*) - count(distinct line) as n_dup_lines, count(*) as n_lines from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
counted as (
    select doc_id, l as language, length(l) || l || s as pool, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join dups using (doc_id) left join repeats using (doc_id)),
judged as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed from counted),
stats as (
    select *, floor(ln(greatest(word_chars, 1)::double / greatest(n_words, 1)::double) * 1000 + 0.5)::bigint as v_length, floor(sqrt(n_symbols / greatest(word_chars, 1)::double) * 1000 + 0.5)::bigint as v_symbol,
        floor(sqrt(n_dup_lines / greatest(n_lines, 1)::double) * 1000 + 0.5)::bigint as v_line, floor(sqrt(n_repeat_words / greatest(n_words, 1)::double) * 1000 + 0.5)::bigint as v_repeat from judged),
good as materialized (select language, pool, {", ".join(VECTOR)} from stats where not base_failed and language in (select language from stats where not base_failed group by language having count(*) >= {rules.least})),
wide as (select language as pool, {", ".join(VECTOR)} from good),
{_determinant("wide", "a", "", rules)},
priors as materialized (select p.pool, {", ".join(MEANS + COVARIANCES)} from (select distinct pool, language from good) p join a{rules.steps} e on e.pool = p.language),
{_determinant("good", "b", "priors", rules)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(({_distance()}) / {rules.consistency} > {rules.cutoff}, false) as kept
from stats left join b{rules.steps} using (pool)
"""
