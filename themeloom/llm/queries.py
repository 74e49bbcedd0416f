"""One query per operator on the test tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from themeloom.functions.storage import stage_folder
from themeloom.llm import (
    conversation_repair,
    decontamination,
    exact_dedup,
    language_id,
    lexical_search,
    line_dedup,
    ngram_model,
    packing,
    pii,
    quality,
    simhash_dedup,
    substring_dedup,
    token_files,
)
from themeloom.llm.shipping import ship

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_units(_table(spark, sf_dir, "documents"))


def op6_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{stage_folder(spark)}/ngrams-{uuid.uuid4().hex}"
    return ngram_model.score_documents(_table(spark, sf_dir, "documents"), folder)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{stage_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return token_files.token_index(spark, folder)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.top_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_simhash_dedup,
        op3_exact_dedup,
        op4_line_dedup,
        op5_substring_dedup,
        op6_ngram_model,
        op7_packing,
        op8_language_id,
        op9_pii,
        op10_token_files,
        op11_conversation_repair,
        op12_quality_classifier,
        op13_lexical_search,
    )
}

LLM_ORACLES: dict[str, str] = {
    # Words with their places; a unit ends with its line, or with a word that ends in a full stop or the like.
    "op5_substring_dedup": """
        with pieces as (select doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+')) as piece,
                unnest(range(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+')))) as i
            from documents where text is not null and doc_id is not null),
        placed as (select *, sum(length(piece)) over (partition by doc_id order by i) as stop, lag(piece) over (partition by doc_id order by i) as before,
            lag(piece, 2) over (partition by doc_id order by i) as word_before from pieces),
        words as (select doc_id, i, piece, stop - length(piece) as start, stop, word_before is not null and contains(before, chr(10)) as new_line,
            word_before is not null and right(word_before, 1) in ('.', '!', '?') as new_sentence from placed where not regexp_matches(piece, '^[\\x20\\x09-\\x0D]')),
        numbered as (
            select doc_id, 'line' as kind, i, piece, start, stop, sum(new_line::int) over (partition by doc_id order by i) as unit from words union all
            select doc_id, 'sentence', i, piece, start, stop, sum(new_sentence::int) over (partition by doc_id order by i) from words),
        units as (select doc_id, kind, unit, min(start) as start, max(stop) as stop, count(*) as n_words,
            string_agg(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' order by i) as plain from numbered group by doc_id, kind, unit),
        ranked as (select *, row_number() over same as place, min(doc_id) over (partition by kind, plain) as keep_id from units
            window same as (partition by kind, plain order by doc_id, unit)),
        runs as (select *, unit - row_number() over (partition by doc_id, kind order by unit) as run from ranked where place > 1),
        weighed as (select *, sum(n_words) over (partition by doc_id, kind, run) as run_words from runs)
        select doc_id, kind, unit::bigint as unit, start::bigint as start, stop::bigint as "end", n_words::bigint as n_words, keep_id
        from weighed where run_words >= 20""",
    "op3_exact_dedup": """
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
            doc_id = min(doc_id) over same as kept, sha256(norm) as text_sha256
        from t window same as (partition by norm)
    """,
    # Shortest paths row by row; cost and letters compare as structs, since no equally cheap repair begins another.
    "op11_conversation_repair": """
        with recursive crc_table as (
            select list(list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as steps
            from (select unnest(range(256)) as n)),
        named as (select *, string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '') as name from conversations),
        checked as (select n.*, xor(list_reduce(list_prepend(4294967295, list_transform(name, lambda c: ord(c)::bigint)),
            lambda c, b: xor(c >> 8, t.steps[(xor(c, b) & 255) + 1])), 4294967295) % 20 as fault from named n, crc_table t),
        damaged as (select conv_id, turn, case when fault = 4 then 'user' else coalesce(role, ' ') end as role,
            case when fault = 1 then '' when fault = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text,
            unnest(case when fault = 0 then [] when fault = 3 then [0, 1] else [0] end) as copy from checked),
        placed as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || ':' || text), copy) as pos from damaged),
        ended as (select *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') as shown,
            pos > min(pos) over (partition by conv_id, role, text) as again, left(role, 1) as said,
            lag(left(role, 1)) over (partition by conv_id order by pos) as before from placed),
        judged as (select *, case when shown = '' then 'blank' when again then 'duplicate' when right(shown, 1) in ('.', '!', '?') then '' else 'truncated' end as fault
            from ended),
        costed as (select *, case when fault = 'truncated' then 5 else 0 end as more, fault in ('blank', 'duplicate') as must_go from judged),
        path as (
            select conv_id, 0::bigint as pos, {'c': 0, 'a': ''} as q0, {'c': 1000000, 'a': ''} as q1, {'c': 1000000, 'a': ''} as q2, {'c': 1000000, 'a': ''} as q3
            from (select distinct conv_id from conversations)
            union all
            select conv_id, pos, {'c': q0.c + 2, 'a': q0.a || 'D'},
                list_min([{'c': q1.c + 2, 'a': q1.a || 'D'}, {'c': case when must_go or said <> 's' then 1000000 else q0.c + more end, 'a': q0.a || 'K'}]),
                list_min([{'c': i2.c + 2, 'a': i2.a || 'D'}, {'c': case when must_go then 1000000 else u.c + more + (said <> 'u')::int end, 'a': u.a || case when said = 'u' then 'K' else 'R' end}]),
                list_min([{'c': i3.c + 2, 'a': i3.a || 'D'}, {'c': case when must_go then 1000000 else i2.c + more + (said <> 'a')::int end, 'a': i2.a || case when said = 'a' then 'K' else 'R' end}])
            from (select *, list_min([q0, q1, i3]) as u from (
                select *, list_min([q3, {'c': i2.c + 5, 'a': i2.a || 'I'}]) as i3 from (
                select p.conv_id, p.q0, p.q1, p.q3, r.pos, r.said, r.more, r.must_go,
                    list_min([p.q2, {'c': p.q0.c + 5, 'a': p.q0.a || 'I'}, {'c': p.q1.c + 5, 'a': p.q1.a || 'I'}, {'c': p.q3.c + 5, 'a': p.q3.a || 'I'}]) as i2
                from path p join costed r on r.conv_id is not distinct from p.conv_id and r.pos = p.pos + 1)))),
        last as (select conv_id, list_min([q0, q3, {'c': i2.c + 5, 'a': i2.a || 'I'}]) as best from (
            select *, list_min([q2, {'c': q1.c + 5, 'a': q1.a || 'I'}]) as i2 from path
            where pos = (select count(*) from costed r where r.conv_id is not distinct from path.conv_id))),
        letters as (select conv_id, unnest(string_split(best.a, '')) as letter, unnest(range(len(best.a))) as place from last where best.a <> ''),
        counted as (select *, sum((letter <> 'I')::int) over w as pos, sum((letter <> 'D')::int) over w as line,
            sum((letter <> 'D')::int) over (partition by conv_id) as lines from letters window w as (partition by conv_id order by place)),
        repaired as (select c.conv_id, string_agg(case when letter = 'K' then r.role when (line - lines % 2) % 2 = 1 then 'user' else 'assistant' end
                || ':' || case when letter = 'I' then '' else r.text end, chr(10) order by place) as text
            from counted c left join costed r on letter <> 'I' and r.conv_id is not distinct from c.conv_id and r.pos = c.pos where letter <> 'D' group by c.conv_id),
        totals as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
            count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
            count(*) filter (where before || said not in ('su', 'ua', 'au')) as illegal from costed group by conv_id)
        select l.conv_id, coalesce(t.gaps, 0)::bigint as gaps, coalesce(t.blank, 0)::bigint as blank, coalesce(t.duplicate, 0)::bigint as duplicate,
            coalesce(t.truncated, 0)::bigint as truncated, coalesce(t.illegal, 0)::bigint as illegal, l.best.c::bigint as cost, l.best.a as audit,
            sha256(coalesce(r.text, '')) as repaired_sha256
        from last l left join totals t on t.conv_id is not distinct from l.conv_id left join repaired r on r.conv_id is not distinct from l.conv_id""",
    "op13_lexical_search": """
        with d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from documents),
        q as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark),
        tf as (select doc_id, term, count(*) as tf from d group by all),
        len as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
        total as (select count(*) as documents, sum(n)::bigint as length from len),
        df as (select term, count(*) as df from tf group by term),
        w as (select term, floor(1000 * ln((2 * documents + 2) / (2 * df + 1)))::bigint as w from df, total),
        asked as (select item_id, term, count(*) as times from q group by all),
        scored as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // length))))::bigint as score
            from asked join w using (term) join tf using (term) join len using (doc_id), total group by all),
        ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
        select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20""",
}
