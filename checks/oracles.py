"""The registered queries in SQL for DuckDB, written against the tables only."""

from __future__ import annotations

# White space as a list of code points.
_SPACE = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS = "(" + "||".join(f"chr({c})" for c in _SPACE) + ")"
NL = "chr(10)"
REPS = "['Enonon', 'Tion', 'Ouen', 'Der', 'Anan']"

BATCH_HEAD = (
    "'Summarise each text and name its themes, as Summary|Theme1,Theme2,Theme3 on one line.' || chr(10) || "
    "'Give at most 3 themes per text, each specific and no longer than 15 words.' || chr(10) || "
)
BATCH_TAIL = (
    " || chr(10) || chr(10) || 'REPLY FORMAT:' || chr(10) || '1: Brief summary here|Theme1,Theme2' || chr(10) || "
    "'2: Brief summary here|Theme1' || chr(10) || '...'"
)
QUESTION_LINE = """'The texts answer this question: "What would you change?"' || chr(10)"""


def _usable(source: str) -> str:
    return f"text is not null and trim(text, {WS}) <> '' and length(text) >= 5 and {source}"


def _clean(key: str, source: str, extra: str = "") -> str:
    return f"""select *, row_number() over (order by row_id) - 1 as idx from (
        select {key} as row_id, trim(text, {WS}) as text{extra},
            row_number() over (partition by trim(text, {WS}) order by {key}) as copy
        from {source} where {_usable('true')}) where copy = 1"""


CTES = {
    "survey": """select doc_id as row_id, case source when 'src3' then null when 'src4' then '   '
        when 'src5' then '  ' || text || chr(9) else text end as text, lang, source from documents""",
    "clean": _clean("doc_id", "documents", ", lang, source"),
    "batches": "select *, idx // 25 as batch_id, idx % 25 as pos from clean",
    "counted": "select doc_id as row_id, length(text) // 4 as n_tokens from documents",
    "named": """select doc_id as row_id, source, list_transform(list_sort(list_transform(
        list_distinct(regexp_extract_all(text, '[A-Za-z]{6,}')), lambda w: {'n': length(w), 'w': w}))[1:5], lambda s: s.w) as l
        from documents""",
    "occ": """select row_id, source, i as pos, l[i + 1] as theme, (50 + (length(l[i + 1]) * 7 + i * 13) % 51) / 100.0::double as confidence
        from (select *, unnest(range(len(l))) as i from named)""",
    # replies: the nth line of a batch goes to its nth text
    "failed": "select batch_id from batches group by batch_id having max(length(text)) > 20000",
    "said": """select batch_id, row_id as src, pos as src_pos, row_number() over (partition by batch_id order by pos) - 1 as pos
        from batches where length(text) >= 60""",
    "parsed": """select b.row_id, b.batch_id, b.pos,
            case when f.batch_id is not null then 'error' when s.src is not null then 'ok' else 'padded' end as status,
            case when f.batch_id is null and s.src is not null then 'doc ' || s.src else 'Error: Analysis failed' end as summary,
            case when f.batch_id is null then s.src end as src
        from batches b left join failed f on f.batch_id = b.batch_id
        left join said s on s.batch_id = b.batch_id and s.pos = b.pos""",
    "parsed_occ": "select p.row_id, o.pos, o.theme, o.confidence from parsed p join occ o on o.row_id = p.src",
    "prompts": f"""select batch_id, count(*) as n_texts, {BATCH_HEAD} {QUESTION_LINE} || 'TEXTS:' || {NL} ||
        string_agg((pos + 1) || ': ' || text, {NL} order by pos) {BATCH_TAIL} as prompt from batches group by batch_id""",
    "lines": f"""select s.batch_id, s.src_pos, (s.src_pos + 1) || ': doc ' || s.src || '|' ||
        coalesce(list_aggregate(list_transform(range(len(n.l)), lambda i: n.l[i + 1] || ' (' ||
            (50 + (length(n.l[i + 1]) * 7 + i * 13) % 51) || '%)'), 'string_agg', ','), '') as line
        from said s join named n on n.row_id = s.src""",
    "replies": f"""select batch_id, string_agg(line, {NL} order by src_pos) as response from lines
        where batch_id not in (select batch_id from failed) group by batch_id""",
    "usage": """select p.batch_id, p.n_texts,
            case when f.batch_id is null then (length(p.prompt) + length(coalesce(r.response, ''))) // 4 else 0 end as tokens_used,
            case when f.batch_id is null then 1 else 0 end as api_calls,
            case when f.batch_id is null then '' else 'text too long' end as errors
        from prompts p left join failed f using (batch_id) left join replies r using (batch_id)""",
    "requests_log": """select event_id, floor(value * 10)::bigint as prompt_tokens, floor(value)::bigint as response_tokens,
        event_type <> 'error' as ok from events""",
    "writes": """select md5(user_id::varchar) as prompt_md5, case when event_type = 'error' then '' else event_type || ' ' || event_id end as response,
        ts as cached_at, event_type in ('click', 'purchase') as is_new from events""",
    "cache": """select prompt_md5, response, cached_at from (select *, row_number() over
        (partition by prompt_md5 order by cached_at desc, is_new desc) as rn from writes) where rn = 1""",
    "looked_up": """select c.c_custkey as request_id, k.response, k.response is not null as hit from customer c left join
        (select * from cache where cached_at >= timestamp '2024-01-24 00:00:00' and response <> '') k
        on k.prompt_md5 = md5(c.c_custkey::varchar)""",
}


def _theme_ctes(prefix: str, occ: str, entries: str) -> dict[str, str]:
    """Counts, case map and per-text themes from a table of occurrences."""
    return {
        f"{prefix}stats": f"""select theme, count(*) as n, sum(confidence) as cs, avg(confidence) as confidence,
            min(row_id * 100 + pos) as seen from {occ} group by theme""",
        f"{prefix}registry": f"""select arg_min(theme, seen) as theme, sum(n)::bigint as n, sum(cs) / sum(n) as confidence, min(seen) as seen
            from {prefix}stats group by lower(theme)""",
        f"{prefix}spelling": f"""select *, row_number() over (partition by lower(theme) order by seen) as seq from {prefix}stats""",
        f"{prefix}running": f"""select theme, target from (select theme, seq, arg_max(theme, n * 1000000 - seq) over
            (partition by lower(theme) order by seq rows between unbounded preceding and current row) as target
            from {prefix}spelling) where seq > 1""",
        f"{prefix}merged": f"""select *, row_number() over (partition by row_id order by pos) as rk from (
            select row_id, target as theme, min(pos) as pos, arg_min(confidence, pos) as confidence from (
                select o.row_id, o.pos, o.confidence, coalesce(m.target, o.theme) as target
                from {occ} o left join {prefix}running m on m.theme = o.theme) group by row_id, target)""",
        f"{prefix}kept": f"select * from {prefix}merged where rk <= 3",
        f"{prefix}used": f"""select theme, count(*) as n, min(row_id * 100 + rk) as seen from {prefix}kept group by theme""",
        f"{prefix}sequence": f"select theme, row_number() over (order by seen) - 1 as seq, n from {prefix}used where theme <> 'NA'",
        f"{prefix}target": f"select theme, upper(left(theme, 1)) as target from {prefix}used where n > 1",
        f"{prefix}final": f"""select row_id, theme, min(rk) as rk from (select k.row_id, k.rk, coalesce(t.target, k.theme) as theme
            from {prefix}kept k left join {prefix}target t on t.theme = k.theme) group by row_id, theme""",
        f"{prefix}entry": f"""select e.row_id, coalesce(avg(m.confidence), 1.0) as average_confidence, count(m.theme) as n_merged,
            coalesce(string_agg(m.theme, '|' order by m.rk) filter (m.rk <= 3), '') as themes,
            count(m.theme) filter (m.rk <= 3) as n_themes
            from {entries} e left join {prefix}merged m on m.row_id = e.row_id group by e.row_id""",
    }


CTES["ids"] = "select doc_id as row_id from documents"
CTES.update(_theme_ctes("", "occ", "ids"))
CTES.update(_theme_ctes("run_", "parsed_occ", "parsed"))
CTES.update(
    {
        "examples": """select x.theme, x.rank, x.row_id, x.total, d.text from (select theme, row_id,
            row_number() over (partition by theme order by row_id) as rank, count(*) over (partition by theme) as total from occ) x
            join documents d on d.doc_id = x.row_id where x.rank <= 30""",
        "known": "select theme, seen, n from registry order by seen limit 20",
        "registered": "select theme, row_number() over (order by seen) - 1 as seq from registry",
        "suggested": """select a.seq as seq1, b.seq as seq2, a.theme as theme1, b.theme as theme2 from registered a join registered b
            on a.seq < b.seq and (contains(lower(a.theme), lower(b.theme)) or contains(lower(b.theme), lower(a.theme)))
            order by 1, 2 limit 10""",
        "merges": "select theme as from_theme, upper(left(theme, 1)) || lower(substr(theme, 2)) as to_theme from stats",
        "valid_merges": """select * from merges where from_theme <> to_theme and to_theme in (select theme from stats)""",
        # the statistics leave out failed batches
        "answered": "select p.*, e.average_confidence, e.themes, e.n_themes, e.n_merged from parsed p join run_entry e using (row_id) where status <> 'error'",
        "spans": """select u.*, epoch_us(timestamp '2024-01-01 00:00:00') + batch_id * 60000000 as start_us,
            epoch_us(timestamp '2024-01-01 00:00:00') + batch_id * 60000000 + tokens_used * 1000 as end_us from usage u""",
        "session": """select (select count(*) from usage) as total_batches, count(*) as total_entries,
            (select sum(tokens_used)::bigint from usage) as total_tokens_used, (select sum(api_calls)::bigint from usage) as total_api_calls,
            (select (max(end_us) - min(start_us)) / 1e6 from spans) as session_duration,
            sum(n_themes)::bigint as n_themes, avg(average_confidence) as overall_confidence from answered""",
        "counts": """select 'original' as stage, theme, count(*) as n, min(row_id * 100 + rk) as seen from run_kept group by theme
            union all select 'consolidated', theme, count(*), min(row_id * 100 + rk) from run_final group by theme""",
    }
)

_NAMES = sorted(CTES, key=len, reverse=True)


def _query(final: str) -> str:
    """Put in front of a statement the tables above that it needs."""
    import re

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    head = ",\n".join(f"{name} as materialized ({CTES[name]})" for name in needed)
    return f"with recursive {head}\n{final}" if needed else final


_EXAMPLE_LIST = f"""string_agg('- "' || text || '"', {NL} order by rank)"""

FINAL = {
    "load_report": f"""select count(*) as original_row_count,
        (select count(distinct trim(text, {WS})) from survey where {_usable('true')}) as cleaned_row_count,
        count(*) - (select count(distinct trim(text, {WS})) from survey where {_usable('true')}) as rows_removed,
        count(*) - (select count(*) from (select distinct text, lang, source from survey)) as duplicate_rows,
        count(*) filter (text is null or trim(text, {WS}) = '') as empty_texts,
        3::bigint as n_columns, 'text,lang,source' as columns, 'text' as text_column from survey""",
    "clean_texts": f"""select row_id, idx, lang, source, md5(text) as text_md5, length(text) as n_chars
        from ({_clean('row_id', 'survey', ', lang, source')})""",
    "clean_conversations": f"""select row_id, idx, conv_id, turn, md5(text) as text_md5
        from ({_clean('conv_id * 2147483648 + turn', 'conversations', ', conv_id, turn')})""",
    "token_counts": "select * from counted",
    "token_distribution": """select count(*) as total_texts, sum(n_tokens)::bigint as total_tokens, round(avg(n_tokens), 6) as mean_tokens,
        min(n_tokens) as min_tokens, max(n_tokens) as max_tokens, l[count(*) // 2 + 1] as median_tokens,
        l[floor(count(*) * 0.25::double)::bigint + 1] as p25, l[floor(count(*) * 0.75::double)::bigint + 1] as p75,
        l[floor(count(*) * 0.90::double)::bigint + 1] as p90, l[floor(count(*) * 0.95::double)::bigint + 1] as p95
        from counted, (select list(n_tokens order by n_tokens) as l from counted) group by l""",
    "batch_size_recommendation": """select n as n_texts, greatest(1, least(floor(3500 / (m + 50))::bigint, n)) as batch_size from
        (select count(*) as n from counted), (select avg(n_tokens) as m from (select n_tokens from counted order by row_id limit 10))""",
    "cost_forecast": """select t + b * 500 + n * 50 as total_tokens, t as text_tokens, b * 500 as prompt_tokens, n * 50 as overhead_tokens,
        b as estimated_batches, round((t + b * 500 + n * 50) / 1000 * 0.01::double, 6) as cost_usd,
        round((t + b * 500 + n * 50) / 1000 * 0.01::double, 4) as estimated_cost_usd,
        round((t + b * 500 + n * 50) / 1000 * 0.01::double / n, 6) as cost_per_text
        from (select n, t, (n + size - 1) // size as b from (select count(*) as n, sum(n_tokens)::bigint as t,
            greatest(1, floor(4000 / (sum(n_tokens) / count(*) + 50))::bigint) as size from counted))""",
    "prompt_token_estimate": """select batch_id, count(*) as n_texts,
        (sum(length(text) // 4) + length('Summarise each text and name its themes.') // 4 + count(*) * 50)::bigint as prompt_tokens
        from batches group by batch_id""",
    "usage_cost": """select ok, sum(prompt_tokens)::bigint as input_tokens, sum(response_tokens)::bigint as output_tokens,
        round(sum(prompt_tokens) / 1000 * 0.005::double + sum(response_tokens) / 1000 * 0.015::double, 6) as cost_usd
        from requests_log group by ok""",
    "fixed_batches": "select row_id, batch_id, pos from batches",
    "packed_batches": """, ranked as materialized (select row_id, n_tokens, row_number() over (order by n_tokens, row_id) as i from counted),
        packed as (
            select 1::bigint as i, 0::bigint as batch_id, 550 + n_tokens as used, 550 + n_tokens >= 3000 as closed from ranked where i = 1
            union all
            select r.i, p.batch_id + (case when p.closed or p.used + r.n_tokens + 50 > 4000 then 1 else 0 end),
                case when p.closed or p.used + r.n_tokens + 50 > 4000 then 550 + r.n_tokens else p.used + r.n_tokens + 50 end,
                (case when p.closed or p.used + r.n_tokens + 50 > 4000 then 550 + r.n_tokens else p.used + r.n_tokens + 50 end) >= 3000
            from packed p join ranked r on r.i = p.i + 1)
        select r.row_id, r.n_tokens, p.batch_id from packed p join ranked r on r.i = p.i""",
    "batch_requests": """select batch_id, n_texts, md5(prompt) as prompt_md5, length(prompt) as prompt_length from prompts""",
    "hinted_batch_requests": f"""select batch_id, count(*) as n_texts, md5(any_value(head) || string_agg((pos + 1) || ': ' || text, {NL} order by pos) {BATCH_TAIL}) as prompt_md5,
        length(any_value(head) || string_agg((pos + 1) || ': ' || text, {NL} order by pos) {BATCH_TAIL}) as prompt_length
        from batches, (select {BATCH_HEAD} 'Themes in use so far: ' || string_agg(theme, ', ' order by seen) || {NL} ||
            'Reuse one where it fits.' || {NL} || 'TEXTS:' || {NL} as head from known) group by batch_id""",
    "theme_writeup_requests": f"""select theme, total, shown, md5(p) as prompt_md5, length(p) as prompt_length from (
        select theme, any_value(total) as total, count(*) as shown, 'Describe the theme "' || theme || '" from the entries below.' || {NL} || {NL} ||
        'Entries with it: ' || any_value(total) || {NL} || 'EXAMPLES (' || count(*) || ' of ' || any_value(total) || '):' || {NL} || {_EXAMPLE_LIST} ||
        case when any_value(total) > count(*) then {NL} || '(and ' || (any_value(total) - count(*)) || ' others)' else '' end ||
        {NL} || {NL} || 'In 1000 words, cover what the theme consists of, how entries differ, and why it matters. Claim nothing the entries do not support.' as p
        from examples group by theme)""",
    "quote_requests": f"""select theme, shown, md5(p) as prompt_md5, length(p) as prompt_length from (
        select theme, count(*) as shown, 'Pick the 5 entries that best show the theme "' || theme || '".' || {NL} || {NL} || 'ENTRIES:' || {NL} ||
        {_EXAMPLE_LIST} || {NL} || {NL} || 'Quote word for word and prefer quotes that show different sides of the theme.' || {NL} || {NL} ||
        'REPLY FORMAT:' || {NL} || 'QUOTE 1: "exact quote text"' || {NL} || 'QUOTE 2: "exact quote text"' || {NL} || '...' as p
        from examples group by theme)""",
    "pair_requests": f"""select theme1, theme2, md5(p) as prompt_md5, length(p) as prompt_length from (select *,
        'Do these two themes mean the same here?' || {NL} || {NL} || 'New theme: "' || theme1 || '"' || {NL} || 'Existing theme: "' || theme2 || '"' || {NL} ||
        'Context: General analysis' || {NL} || {NL} || 'REPLY FORMAT:' || {NL} || 'Answer: Yes/No' || {NL} || 'Confidence: 0-100%' || {NL} ||
        'Reason: Brief explanation' as p from suggested)""",
    "mapping_requests": f"""select chunk_id, md5(p) as prompt_md5, length(p) as prompt_length from (select seq // 20 as chunk_id,
        'Place each theme below under the broad theme closest to it.' || {NL} || {NL} ||
        'BROAD THEMES: Enonon, Tion, Ouen, Der, Anan' || {NL} || {NL} || 'THEMES TO PLACE:' || {NL} || string_agg(theme, ', ' order by seq) ||
        {NL} || {NL} || 'REPLY FORMAT:' || {NL} || 'Original Theme 1 -> Representative Theme' || {NL} || 'Original Theme 2 -> Representative Theme' || {NL} ||
        '...' || {NL} || {NL} || 'Spell the broad themes as they are above.' as p from sequence group by seq // 20)""",
    "consolidation_request": f"""select chunk_id, n_themes, md5(p) as prompt_md5, length(p) as prompt_length from (select seq // 500 as chunk_id, count(*) as n_themes,
        'Answers to an open question were tagged with the ' || count(*) || ' themes below, each with its number of answers if known. Replace them by 10 broader themes that leave none out; themes with many answers should decide.' ||
        {NL} || {QUESTION_LINE} || {NL} || 'THEMES:' || {NL} || string_agg('- ' || theme || ' (' || n || ')', {NL} order by seq) || {NL} || {NL} ||
        'Write the names in sentence case, none longer than 15 words.' ||
        {NL} || {NL} || 'REPLY FORMAT, 10 lines and nothing else:' || {NL} || '1. [Consolidated Theme Name]' || {NL} || '2. [Consolidated Theme Name]' || {NL} || '...' as p
        from sequence group by seq // 500)""",
    "cache_lookup": "select * from looked_up",
    "cache_upsert": "select prompt_md5, response, epoch_us(cached_at) as cached_us from cache",
    "cache_stats": "select count(*) filter (hit) as hits, count(*) filter (not hit) as misses, round(avg(hit::int), 6) as hit_rate from looked_up",
    "cache_expire": """select count(*) filter (cached_at < timestamp '2024-01-24 00:00:00') as removed,
        count(*) filter (cached_at >= timestamp '2024-01-24 00:00:00') as kept from writes""",
    "usage_stats": """select count(*) as total_requests, (sum(prompt_tokens + response_tokens) filter (ok))::bigint as total_tokens,
        count(*) filter (not ok) as failed_requests, round(avg(ok::int), 6) as success_rate,
        round(sum(prompt_tokens + response_tokens) filter (ok) / count(*), 6) as tokens_per_request from requests_log""",
    "embedding_lookup": """select d.doc_id as row_id, e.embedding is not null as found, len(e.embedding)::bigint as n_dims,
        round(list_sum(e.embedding::double[]), 4) as total from documents d left join embeddings e on e.vec_id = d.doc_id""",
    "model_batch_inference": """select batch_id, case when ok then response end as response, case when not ok then 'prompt too long' end as error,
        case when ok then (n + length(response)) // 4 else 0 end as tokens_used, case when ok then 1 else 0 end::bigint as api_calls,
        case when ok then '' else 'prompt too long' end as errors
        from (select batch_id, length(prompt) as n, length(prompt) <= 100000 as ok,
            '1: ' || length(prompt) || ' characters|Length (90%)' as response from prompts)""",
    "batch_usage": "select batch_id, n_texts, tokens_used::bigint as tokens_used, api_calls::bigint as api_calls, errors from usage",
    "parsed_entries": """select p.row_id, p.batch_id, p.pos, p.status, p.summary, coalesce(len(n.l), 0)::bigint as n_themes
        from parsed p left join named n on n.row_id = p.src""",
    "parsed_themes": "select row_id, pos, theme, round(confidence, 6) as confidence from parsed_occ",
    "parsed_consolidation": """select source, array_to_string((l[1:4] || list_transform(l, lambda x: lower(x)) || l[5:])[1:10], '|') as names
        from (select source, list_sort(list(distinct upper(left(theme, 2)))) as l from occ group by source)""",
    "parsed_mapping": f"""select theme, case when failed or regexp_matches(theme, '^[A-D]') then 'Enonon'
        when regexp_matches(theme, '^[E-N]') then 'Tion' when regexp_matches(theme, '^[O-Z]') then 'Ouen'
        else coalesce(list_filter({REPS}, lambda r: contains(lower(r), left(theme, 3)) or contains(left(theme, 3), lower(r)))[1], 'Enonon') end as target
        from (select theme, bool_or(regexp_matches(theme, '^[A-Z]+$')) over (partition by seq // 20) as failed from sequence)""",
    "parsed_quotes": """select conv_id, turn, least(len(l), 5)::bigint as n_quotes, md5(array_to_string(l[1:5], '|')) as quotes_md5
        from (select conv_id, turn, str_split(text, chr(10)) as l from conversations)""",
    "parsed_verdicts": """select event_id, event_type in ('click', 'view') as similar,
        case when event_type in ('error', 'signup') then 0 else floor(value)::bigint end as confidence,
        case when event_type = 'error' then 'Validation failed' else props end as reason from events""",
    "theme_registry": "select theme, n, round(confidence, 6) as confidence from registry",
    "theme_frequency": "select theme, n from stats",
    "theme_confidence": "select theme, n, round(confidence, 6) as confidence from stats",
    "case_map_running": "select theme, target from running",
    "case_map_global": """select theme, target from (select theme, seq, arg_max(theme, n * 1000000 - seq) over
        (partition by lower(theme)) as target from spelling) where seq > 1 or target <> theme""",
    "entry_themes": "select row_id, themes, n_merged, round(average_confidence, 6) as average_confidence from entry",
    "themes_merged": "select count(distinct theme) - count(distinct lower(theme)) as themes_merged from occ",
    "entry_theme_limits": """select i.row_id, coalesce(k.themes, '') || case when coalesce(k.kept, 0) < least(3, coalesce(k.n, 0)) then
            (case when k.kept > 0 then '|' else '' end) || 'NA' else '' end as themes, round(coalesce(k.total, 0), 6) as confidence_sum
        from ids i left join (select row_id, count(*) as n, count(*) filter (sure and rk <= 3) as kept,
            coalesce(string_agg(theme, '|' order by rk) filter (sure and rk <= 3), '') as themes,
            sum(confidence) filter (sure and rk <= 3) as total
            from (select *, confidence >= 0.6 as sure, row_number() over (partition by row_id order by confidence desc, pos) as rk from occ)
            group by row_id) k on k.row_id = i.row_id""",
    "high_confidence_themes": """select i.row_id, coalesce(string_agg(k.theme, '|' order by k.rk) filter (k.confidence >= 0.8), '') as themes
        from ids i left join kept k on k.row_id = i.row_id group by i.row_id""",
    "entry_confidence": """select i.row_id, round(coalesce(avg(o.confidence), 1.0), 6) as average_confidence
        from ids i left join occ o on o.row_id = i.row_id group by i.row_id""",
    "distinct_themes": "select theme, seq from sequence",
    "needs_consolidation": """select n::bigint as final_count, (select count(*) from used where theme <> 'NA') > n as consolidate
        from (select unnest([10, 1000, 1000000]) as n)""",
    "consolidated_themes": """select i.row_id, coalesce(string_agg(f.theme, '|' order by f.rk), '') as consolidated
        from ids i left join final f on f.row_id = i.row_id group by i.row_id""",
    "fallback_themes": "select theme, n from stats order by n desc, seen limit 10",
    "containment_pairs": """select a.seq as seq1, b.seq as seq2 from sequence a join sequence b
        on a.seq < b.seq and (contains(lower(a.theme), lower(b.theme)) or contains(lower(b.theme), lower(a.theme)))""",
    "merge_suggestions": "select *, 0.8::double as similarity, 'review' as recommendation from suggested",
    "merged_themes": """select theme, sum(n)::bigint as n, round(sum(cs) / sum(n), 6) as confidence from
        (select coalesce(v.to_theme, s.theme) as theme, s.n, s.cs from stats s left join valid_merges v on v.from_theme = s.theme) group by theme""",
    "merge_outcome": """select from_theme, to_theme, from_theme <> to_theme and to_theme in (select theme from stats) as merged from merges""",
    "top_themes": "select theme, n from registry order by n desc, seen limit 25",
    "theme_totals": "select count(*) as unique_themes, sum(n)::bigint as total_occurrences from stats",
    "theme_lookup": """select a.theme, coalesce(s.n, 0) as n, round(coalesce(s.confidence, 0.0), 6) as confidence
        from (select theme from stats union select upper(theme) from stats) a left join stats s on s.theme = a.theme""",
    "theme_examples": "select theme, rank, row_id, total, md5(text) as text_md5 from examples",
    "known_themes": "select theme, n from known",
    "result_rows": """select c.row_id, c.lang, c.source, p.summary, replace(e.themes, '|', ', ') as themes,
        coalesce((select string_agg(theme, ', ' order by pos) from parsed_occ o where o.row_id = c.row_id), '') as original_themes,
        coalesce((select string_agg(theme, ', ' order by rk) from run_final f where f.row_id = c.row_id), '') as consolidated_themes,
        e.n_themes as theme_count, (select count(*) from parsed_occ o where o.row_id = c.row_id) as original_theme_count,
        (select count(*) from run_final f where f.row_id = c.row_id) as consolidated_theme_count,
        round(e.average_confidence, 6) as average_confidence,
        (select count(*) from parsed_occ o where o.row_id = c.row_id) - e.n_themes as themes_filtered, md5(c.text) as text_md5
        from clean c join parsed p on p.row_id = c.row_id join run_entry e on e.row_id = c.row_id""",
    "batch_stats": """select s.batch_id, count(a.row_id) as n_entries, round((s.end_us - s.start_us) / 1e6, 6) as duration_seconds,
        s.tokens_used::bigint as tokens_used, s.api_calls::bigint as api_calls, case when s.errors = '' then 0 else 1 end::bigint as n_errors,
        round(coalesce(avg(a.average_confidence), 0.0), 6) as average_confidence,
        round(coalesce(avg((a.n_themes > 0)::int), 0.0), 6) as success_rate
        from spans s left join answered a on a.batch_id = s.batch_id group by all""",
    "session_stats": """select total_batches, total_entries, total_tokens_used, total_api_calls, round(session_duration, 6) as session_duration,
        round(total_entries / total_batches, 6) as average_batch_size, round(total_tokens_used / total_entries, 6) as tokens_per_entry,
        (select count(*) from run_used_answered) as unique_themes, round(n_themes / total_entries, 6) as average_themes_per_entry,
        round(overall_confidence, 6) as overall_confidence from session""",
    "processing_stats": """select count(*) as total_batches, (sum(n_texts) filter (errors = ''))::bigint as total_texts_processed,
        count(*) filter (errors <> '') as failed_batches, round(avg((errors = '')::int), 6) as success_rate,
        round(sum(end_us - start_us) / 1e6, 6) as total_processing_time, round(sum(end_us - start_us) / 1e6 / count(*), 6) as average_time_per_batch,
        25::bigint as batch_size from spans""",
    "theme_count_tables": "select stage, theme, n from counts",
    "charted_themes": """select stage, theme, n from (select *, row_number() over (partition by stage order by n desc, seen) as rk from counts) where rk <= 15""",
    "theme_report": "select theme, n as frequency from counts where stage = 'consolidated'",
    "report_statistics": """select total_entries, (select count(*) from counts where stage = 'consolidated') as unique_themes,
        round(session_duration, 6) as processing_time_seconds, round(n_themes / total_entries, 6) as average_themes_per_entry,
        round(overall_confidence, 6) as overall_confidence from session""",
    "summary_metrics": """, f as (select (select count(*) from answered) as entries,
            (select sum(n)::bigint from counts where stage = 'original') as o, (select count(*) from counts where stage = 'original') as ou,
            (select theme || ' (' || n || ')' from counts where stage = 'original' order by n desc, seen limit 1) as oc,
            (select sum(n)::bigint from counts where stage = 'consolidated') as c, (select count(*) from counts where stage = 'consolidated') as cu,
            (select theme || ' (' || n || ')' from counts where stage = 'consolidated' order by n desc, seen limit 1) as cc,
            (select sum(tokens_used)::bigint from usage) as tokens, (select count(*) from usage) as nb,
            (select string_agg(size || ' x ' || k, ', ' order by size desc) from (select size, count(*) as k from
                (select u.batch_id, count(a.row_id) as size from usage u left join answered a on a.batch_id = u.batch_id group by u.batch_id) group by size)) as sizes)
        select unnest(range(1, 17)) as position, unnest(['Total Entries Processed', 'Total Original Theme Occurrences', 'Unique Original Themes',
            'Most Common Original Theme', 'Total Consolidated Theme Occurrences', 'Unique Consolidated Themes', 'Most Common Consolidated Theme',
            'Average Themes per Entry (Original)', 'Average Themes per Entry (Consolidated)', 'Theme Consolidation Ratio', 'Total Tokens Used',
            'Total Batches Processed', 'Average Tokens per Batch', 'Configured Batch Size', 'Actual Average Batch Size', 'Batch Sizes']) as metric,
        unnest([entries::varchar, o::varchar, ou::varchar, oc, c::varchar, cu::varchar, cc, printf('%.6f', o / entries), printf('%.6f', c / entries),
            ou || ' → ' || cu, tokens::varchar, nb::varchar, printf('%.0f', tokens / nb), '25', printf('%.1f', entries / nb), sizes]) as value from f""",
    "analysis_summary": """select total_batches, total_entries, round(overall_confidence, 6) as overall_confidence,
        (select count(*) from reg) as unique_themes, (select count(distinct theme) - count(distinct lower(theme)) from parsed_occ) as themes_merged,
        (select sum(n)::bigint from reg) as total_occurrences, (select count(*) from usage where errors <> '') as failed_batches,
        (select string_agg(theme || ' ' || n, '|' order by n desc, seen) from (select * from reg order by n desc, seen limit 10)) as top_themes
        from session""",
    "statistics_json": """select 'theme_frequencies' as section, '{"theme":"' || theme || '","frequency":' || n || '}' as json from counts where stage = 'consolidated'
        union all select 'top_10_themes', '[' || string_agg('{"theme":"' || theme || '","frequency":' || n || '}', ',' order by n desc, seen) || ']'
        from (select * from counts where stage = 'consolidated' order by n desc, seen limit 10)
        union all select 'analysis_summary', printf('total_entries=%.4f unique_themes=%.4f processing_time_seconds=%.4f average_themes_per_entry=%.4f overall_confidence=%.4f',
            total_entries::double, (select count(*) from counts where stage = 'consolidated')::double, session_duration::double,
            n_themes / total_entries, overall_confidence) from session""",
    "result_json": """select p.row_id, md5('{"original_text":' || to_json(d.text) || ',"summary":' || to_json(p.summary) || ',"themes":' ||
            to_json(coalesce((select list(theme order by rk) from run_kept k where k.row_id = p.row_id), []::varchar[])) ||
            ',"theme_confidences":{},"original_themes":[],"original_theme_confidences":{},"consolidated_themes":' ||
            to_json(coalesce((select list(theme order by rk) from run_final f where f.row_id = p.row_id), []::varchar[])) || '}') as json_md5
        from parsed p join documents d on d.doc_id = p.row_id""",
    "result_json_confidences": """select row_id, 'original_theme_confidences' as kind, theme, round(confidence, 6) as confidence from parsed_occ
        union all select row_id, 'theme_confidences', theme, round(confidence, 6) from run_merged""",
    "missing_cells": """select conv_id, turn, case when turn % 2 = 0 then case when text not in ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN',
            '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') then text end
        when conv_id % 21 = 19 then ' NA' when conv_id % 21 = 20 then 'none' end as cell from conversations""",
    "decoded_texts": "select doc_id, md5(text) as text_md5 from documents",
    "flat_results": """select m.row_id, (select string_agg(theme, ', ' order by rk) from run_kept k where k.row_id = m.row_id) as themes,
        (select string_agg(theme, ', ' order by rk) from run_final f where f.row_id = m.row_id) as consolidated,
        '{"theme":"' || arg_max(m.theme, m.rk) || '"}' as last from run_merged m group by m.row_id""",
    "consolidation_rounds": """select row_number() over (order by theme) - 1 as position, theme from
        (select distinct upper(left(theme, 1)) as theme from sequence) order by theme limit 10""",
    "theme_registry_padded": """, padded as (select row_id, pos * 3 as pos, theme from occ union all select row_id, pos * 3 + 1, upper(theme) from occ
            union all select row_id, pos * 3 + 2, theme from occ),
        spelled as (select theme, count(*) as n, min(row_id * 100 + pos) as seen from padded group by theme)
        select arg_min(theme, seen) as theme, sum(n)::bigint as n, min(seen) // 100 as first_row, min(seen) % 100 as first_pos from spelled group by lower(theme)""",
    "batch_json": """select s.batch_id, s.tokens_used::bigint as tokens_used, count(p.row_id) as n_results, string_agg(p.summary, '|' order by p.pos) as summaries,
        case when s.errors = '' then sum(e.n_themes)::bigint end as n_themes, round((s.end_us - s.start_us) / 1e6, 6) as processing_duration
        from spans s join parsed p on p.batch_id = s.batch_id join run_entry e on e.row_id = p.row_id group by s.batch_id, s.tokens_used, s.errors, s.end_us, s.start_us""",
    "theme_cooccurrence": """, pairs as (select a.theme as theme1, b.theme as theme2, count(*) as n_both from kept a join kept b
            on a.row_id = b.row_id and a.theme < b.theme group by 1, 2)
        select p.*, x.n as n1, y.n as n2, round(n_both / (x.n + y.n - n_both), 6) as jaccard
        from pairs p join used x on x.theme = p.theme1 join used y on y.theme = p.theme2""",
    "similar_vectors": """, pairs as materialized (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id <> b.vec_id
            and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.4),
        reach as (select a as id, a as other from pairs union select r.id, p.b from reach r join pairs p on p.a = r.other)
        select id, arg_max(other, coalesce(n_chars, 0) * 1000000 - other) as target from reach left join documents on doc_id = other group by id""",
    "similar_vectors_in_cells": """, pairs as materialized (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id <> b.vec_id
            and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.4),
        reach as (select a as id, a as other from pairs union select r.id, p.b from reach r join pairs p on p.a = r.other),
        best as (select id, arg_max(other, (other % 7) * 1000000 - other) as target from reach group by id)
        select a.label || ' ' || a.vec_id as theme, b.label || ' ' || b.vec_id as target from best
            join embeddings a on a.vec_id = best.id join embeddings b on b.vec_id = best.target where id <> target""",
    "hierarchy_rollup": """select parent, child, count(distinct row_id) as n_texts from (select row_id, theme as child,
            unnest([upper(left(theme, 1)), 'length ' || length(theme)]) as parent from occ) group by rollup (parent, child)""",
    "theme_quality": """select theme, n, round(confidence, 6) as confidence, case_variants, n = 1 as is_singleton, confidence < 0.6 as low_confidence,
        case when n = 1 or confidence < 0.6 or case_variants > 1 then 'review' else 'ok' end as status
        from (select *, count(*) over (partition by lower(theme)) as case_variants from stats)""",
}
FINAL["csv_files"] = FINAL["tsv_files"] = """select doc_id, case when text not in ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan',
    '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') then md5(text) end as text_md5, lang, n_chars::bigint as n_chars
    from documents"""
FINAL["streamed_first_copies"] = f"""select row_id, source, md5(text) as text_md5 from ({_clean('row_id', 'survey', ', source')})"""
FINAL["registry_of_runs"] = """select theme, n, round(confidence, 6) as confidence, seen // 100 as first_row, seen % 100 as first_pos from registry"""
FINAL["bucketed_cache"] = FINAL["cache_lookup"]
FINAL["banded_recall"] = """select t as threshold, count(*) as pairs, true as enough from embeddings a, embeddings b, (select unnest([0.3, 0.35, 0.4])::double as t)
    where a.vec_id % 10 = 0 and a.vec_id <> b.vec_id and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= t group by t"""
FINAL["banded_vectors"] = """, pairs as materialized (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id <> b.vec_id
        and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.4),
    reach as (select a as id, a as other from pairs union select r.id, p.b from reach r join pairs p on p.a = r.other)
    select id, min(other) as target from reach group by id"""
CTES["documents_whole"] = """select p.batch_id, p.pos, p.row_id, md5(concat_ws('~', d.text, p.summary,
        coalesce((select string_agg(theme, '|' order by rk) from run_kept k where k.row_id = p.row_id), ''),
        coalesce((select string_agg(theme || ':' || round(confidence * 100)::int, '|' order by theme) from run_merged k where k.row_id = p.row_id), ''),
        coalesce((select string_agg(theme, '|' order by pos) from parsed_occ k where k.row_id = p.row_id), ''),
        coalesce((select string_agg(theme || ':' || round(confidence * 100)::int, '|' order by theme) from parsed_occ k where k.row_id = p.row_id), ''),
        coalesce((select string_agg(theme, '|' order by rk) from run_final k where k.row_id = p.row_id), ''))) as document
    from parsed p join documents d on d.doc_id = p.row_id"""
FINAL["result_variants"] = "select row_id, document from documents_whole"
FINAL["batch_json"] = FINAL["batch_variants"] = f"""select b.batch_id, (select string_agg(document, ',' order by pos) from documents_whole w where w.batch_id = b.batch_id) as results,
        s.start_us, s.end_us, b.duration_seconds as processing_duration, b.tokens_used, b.api_calls, s.errors, b.average_confidence, b.success_rate,
        (select string_agg(theme || ':' || n, '|' order by theme) from (select k.theme, count(*) as n from run_kept k join answered a on a.row_id = k.row_id
            where a.batch_id = b.batch_id group by k.theme)) as themes_summary
    from ({FINAL["batch_stats"]}) b join spans s on s.batch_id = b.batch_id"""
_SESSION = ("total_batches", "total_entries", "total_tokens_used", "total_api_calls", "session_duration", "average_batch_size", "tokens_per_entry",
            "unique_themes", "average_themes_per_entry", "overall_confidence")
_PROCESSING = ("total_batches", "total_texts_processed", "failed_batches", "success_rate", "total_processing_time", "average_time_per_batch", "batch_size")
FINAL["analysis_summary"] = f"""select {", ".join(f"s.{c} as session_stats_{c}" for c in _SESSION)}, {", ".join(f"p.{c} as processing_stats_{c}" for c in _PROCESSING)},
    (select count(*) from reg) as theme_stats_unique_themes, (select count(distinct theme) - count(distinct lower(theme)) from parsed_occ) as theme_stats_themes_merged,
    (select sum(n)::bigint from reg) as theme_stats_total_occurrences, (select sum(n)::bigint from reg) as theme_stats_total_themes_processed,
    (select string_agg(theme || ' ' || n, '|' order by n desc, seen) from (select * from reg order by n desc, seen limit 10)) as top_themes
    from ({FINAL["session_stats"]}) s, ({FINAL["processing_stats"]}) p"""
FINAL["parsed_consolidation"] = """, named_by as (select source, unnest(range(len(l))) as i, unnest(l) as theme from
        (select source, list_sort(list(distinct theme)) as l from occ group by source)),
    told as (select source, 2 * i as spot, theme from named_by union all select source, 2 * i + 1, lower(theme) from named_by),
    placed as (select source, theme, row_number() over (partition by source order by min(spot)) as k from told group by source, theme)
    select source, string_agg(theme, '|' order by k) as names from placed where k <= 10 group by source"""
FINAL["sketched_bounds"] = """select unnest(['median_tokens', 'p25', 'p75', 'p90', 'p95', 'unique_themes']) as measure, null::bigint as exact, true as within
    union all select unnest(['total_texts', 'total_tokens', 'min_tokens', 'max_tokens', 'total_occurrences']),
        unnest([count(*), sum(n_tokens)::bigint, min(n_tokens), max(n_tokens), (select count(*) from occ)]), true from counted"""
FINAL["checked_tables"] = """select 'documents' as name, true as ok, 'ok' as message, count(text) as n from documents
    union all select 'conversations', false, 'no column speaker, mood among ' || (select string_agg(column_name, ', ' order by ordinal_position)
        from information_schema.columns where table_name = 'conversations'), count(text) from conversations
    union all select 'embeddings', false, 'column embedding holds array<' || case when any_value(typeof(embedding)) = 'FLOAT[]' then 'float' else 'double' end ||
        '>, not strings', count(embedding) from embeddings
    union all select 'pages', true, 'ok', count(html) from pages"""
FINAL["journaled_inference"] = """select batch_id, case when batch_id % 2 = 0 and length(prompt) <= 100000
    then '1: ' || length(prompt) || ' characters|Length (90%)' else 'late' end as response, null::varchar as error from prompts"""
FINAL["calls_by_kind"] = f"""select prompt_md5, kind || prompt_length as response from (
    select 'batch 0.5 20000 ' as kind, prompt_md5, prompt_length from ({FINAL["batch_requests"]})
    union all select 'mapping 0.2 1000 ', prompt_md5, prompt_length from ({FINAL["mapping_requests"]})
    union all select 'consolidation 0.3 1000 ', prompt_md5, prompt_length from ({FINAL["consolidation_request"]}))"""
CTES["edges"] = """select distinct unnest(['* ' || upper(left(theme, 2)), '* ' || upper(left(theme, 1)), '*', 'length ' || length(theme),
    'length ' || length(theme), 'length ' || (length(theme) + 1 - 2 * (length(theme) % 2))]) as parent, unnest([theme, '* ' || upper(left(theme, 2)),
    '* ' || upper(left(theme, 1)), theme, 'length ' || (length(theme) + 1 - 2 * (length(theme) % 2)), 'length ' || length(theme)]) as child from occ"""
CTES["reach"] = "select parent as ancestor, child as descendant from edges union select r.ancestor, e.child from reach r join edges e on e.parent = r.descendant"
FINAL["hierarchy_closure"] = f""", reach as ({CTES["reach"]}) select ancestor, descendant from reach"""
FINAL["hierarchy_counts"] = f""", reach as ({CTES["reach"]}),
    scope as (select ancestor, descendant from reach where ancestor <> descendant union all select distinct theme, theme
        from (select ancestor as theme from reach union select descendant from reach)),
    texts as (select s.ancestor, count(distinct o.row_id) as n_texts, count(distinct o.row_id) filter (s.ancestor = s.descendant) as n_own
        from scope s join occ o on o.theme = s.descendant group by s.ancestor),
    loops as (select r.ancestor, min(r.descendant) as cycle from reach r join reach b on b.ancestor = r.descendant and b.descendant = r.ancestor group by r.ancestor)
    select s.ancestor as theme, coalesce(t.n_own, 0) as n_own, coalesce(t.n_texts, 0) as n_texts, count(*) - 1 as n_below, l.cycle
    from scope s left join texts t on t.ancestor = s.ancestor left join loops l on l.ancestor = s.ancestor group by all"""
del CTES["reach"]
CTES["run_used_answered"] = "select distinct theme from run_kept where row_id in (select row_id from answered)"
CTES["mstats"] = """select theme, count(*) as n, min(row_id * 100 + rk) as seen from run_merged group by theme"""
CTES["reg"] = "select arg_min(theme, seen) as theme, sum(n)::bigint as n, min(seen) as seen from mstats group by lower(theme)"


def _assemble(final: str) -> str:
    if not final.startswith(", "):
        return _query(final)
    # The statement brings tables of its own, which follow the shared ones.
    own = final[2:]
    shared = _query(own)
    return shared.removesuffix(own).rstrip() + f",\n{own}" if shared != own else f"with recursive {own}"


ORACLES: dict[str, str] = {name: _assemble(final) for name, final in FINAL.items()}
