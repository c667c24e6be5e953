"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backtrack, decontaminate, licenses, resample
from .bpe import token_report
from .common import read
from .decontaminate import contaminated_pairs
from .fingerprint import edit_report
from .licenses import license_report
from .periods import period_report
from .quality import quality_report
from .secrets import secret_report
from .shards import shard_documents
from .toxicity import toxicity_report
from .warc import archive_report
from .simhash import near_duplicates


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: Rank file and split pattern of the tokenizer that op6 and the pipeline apply.
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(read(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(read(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), shards=24)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return pairs.withColumn("score", F.round("score", 9))  # sums of doubles differ by their order


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_report(read(spark, sf_dir, "documents"))


#: Tokenizer that op12 applies.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op12_backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtrack.token_report(read(spark, sf_dir, "documents"), TOKENIZER)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_fingerprints": op2_fingerprints,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_bpe": op6_bpe,
    "op7_secrets": op7_secrets,
    "op8_licenses": op8_licenses,
    "op9_shards": op9_shards,
    "op10_decontaminate": op10_decontaminate,
    "op11_periods": op11_periods,
    "op12_backtrack": op12_backtrack,
    "op13_resample": op13_resample,
}

#: CRC-32 of a text's bytes, one by one over the table of the reversed polynomial.
_CRC = """
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(data)), lambda k: ('0x' || substr(hex(data), (2 * k + 1)::int, 2))::bigint)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint)
"""
#: Kinds of secrets in order: pattern, and the least length of a match (of its second group, for the first kind).
_SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))[''"]?\x20*[:=]\x20*[''"]?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", "AKIA[A-Z0-9]+", 16),
    ("hex", "[0-9a-f]+", 32),
    ("forge", "gh[pousr]_[A-Za-z0-9]+", 40),
    ("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)
#: A match begins after the pieces between matches and the matches before it.
_FOUND = " union all ".join(
    f"""select r, {o} as o, '{kind}' as kind, m[i] as hit, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as start
        from (select r, m, s, unnest(range(1, len(m) + 1)) as i from (select r, regexp_extract_all(text, '{pattern}') as m, regexp_split_to_array(text, '{pattern}') as s from d))
        where length({f"regexp_extract(m[i], '{pattern}', 2)" if o == 0 else "m[i]"}) >= {least}"""
    for o, (kind, pattern, least) in enumerate(_SECRETS)
)
#: Rows of the phrases: words, whether it is a base phrase, and its label.
_PHRASES = ", ".join(f"({phrase.split()}, {phrase in licenses.BASE}, '{label}')" for phrase, label in (licenses.BASE | licenses.NOTICES).items())
_FAMILY = "case " + " ".join(f"when regexp_matches(t, '^{begin}{licenses.FOLLOWS}') then '{label}'" for begin, label in licenses.FAMILIES.items()) + " else 'other' end"
_WEIGHT = "case label " + " ".join(f"when '{label}' then {w}::double" for label, w in licenses.WEIGHT.items()) + f" else {licenses.UNKNOWN}::double end"
_TAG = "|".join(licenses.TAGS)
#: Runs of five words (of fewer: all) of a list of words.
_RUNS = lambda words: f"(case when len({words}) <= 5 then [array_to_string({words}, ' ')] else list_transform(range(1, len({words}) - 3), lambda k: array_to_string(({words})[k:k + 4], ' ')) end)"
#: The table that ``_CRC`` reads, as ``tab``.
_CRC_TABLE = "select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab from (select unnest(range(256)) as i)"
_LOW = lambda column: f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL: dict[str, str] = {
    "op13_resample": rf"""
        with t as ({_CRC_TABLE}),
        d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        dw as (select r, unnest(w) as word from d),
        bw as (select unnest(regexp_extract_all({_LOW("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
        v as (select word, encode(word) as data from (select word from dw union select word from bw)),
        k as (select word, {_CRC} % {resample.BUCKETS} as bucket from v, t),
        source as (select bucket, count(*) as s from dw join k using (word) group by bucket),
        target as (select bucket, count(*) as t from bw join k using (word) group by bucket),
        whole as (select coalesce((select sum(s) from source), 0) as s_all, coalesce((select sum(t) from target), 0) as t_all),
        gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + {resample.BUCKETS})::double / ((s + 1)::double * (t_all + {resample.BUCKETS})::double)))::bigint as gain from source left join target using (bucket), whole),
        weight as (select r, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from dw join k using (word) join gain using (bucket) group by r),
        scored as (select r, doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
                          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resample.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from d left join weight using (r)),
        placed as (select *, case when n_features >= {resample.LEAST_WORDS} then row_number() over (partition by n_features >= {resample.LEAST_WORDS} order by score desc, doc_id nulls last, n_features, weight) end as place from scored)
        select doc_id, n_features, weight, score, case when place <= (select count(*) * {resample.PERCENT} // 100 from placed where n_features >= {resample.LEAST_WORDS}) then place end as rank from placed
    """,
    "op8_licenses": rf"""
        with recursive d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
        w as (select r, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from d),
        phrases as (select * from (values {_PHRASES}) as p(words, base, label)),
        begins as (select r, word, pos from (select r, unnest(w) as word, unnest(range(len(w))) as pos from w) where word in (select words[1] from phrases)),
        noted as (select r, label, base, pos from begins join phrases on word = words[1] join w using (r) where w[pos + 1:pos + len(words)] = words),
        tagged as (select r, low, regexp_extract_all(low, '{_TAG}') as m, regexp_split_to_array(low, '{_TAG}') as s from d where regexp_matches(low, '{_TAG}')),
        place as (select r, low, i, list_sum(list_transform(s[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) as pos from (select *, unnest(range(1, len(m) + 1)) as i from tagged)),
        told as (select r, i, regexp_extract_all(split_part(split_part(substr(low, pos::bigint + 1), chr(10), 1), '*/', 1), '\(|\)|[a-z0-9][a-z0-9.+:-]*') as tokens from place),
        scan as (
            select r, i, tokens, 0 as k, false as operand, 0 as depth, 0 as best from told
            union all
            select r, i, tokens, k + 1, operand_, depth_, case when operand_ and depth_ = 0 then k + 1 else best end
            from (select *, t not in ('or', 'and', 'with', '(') as operand_, depth + case t when '(' then 1 when ')' then -1 else 0 end as depth_ from (select *, tokens[k + 1] as t from scan where k < len(tokens))
                  where case when t in ('or', 'and', 'with', ')') then operand and (t <> ')' or depth > 0) else not operand end)
        ),
        expression as (select r, i, any_value(tokens)[1:max(best)] as tokens from scan group by r, i having max(best) > 0),
        yard as (
            select r, i, tokens, 0 as k, []::varchar[] as ops, []::struct(labels varchar[], weight double)[] as vals, false as done from expression
            union all
            select r, i, tokens,
                case when pop then k else k + 1 end,
                case when pop or t = ')' then ops[:-2] when t in ('or', 'and', 'with', '(') then list_append(ops, t) else ops end,
                case when pop then list_append(vals[:-3], case top when 'with' then {{'labels': a.labels, 'weight': a.weight * 0.75::double}}
                                                                   else {{'labels': list_distinct(a.labels || b.labels), 'weight': case top when 'or' then least(a.weight, b.weight) else greatest(a.weight, b.weight) end}} end)
                     when t is null or t in ('or', 'and', 'with', '(', ')') then vals else list_append(vals, {{'labels': [label], 'weight': {_WEIGHT}}}) end,
                t is null and not pop
            from (select *, {_FAMILY} as label, vals[-2] as a, vals[-1] as b,
                         coalesce(top <> '(' and case when t is null or t = ')' then true when t in ('or', 'and', 'with') then list_position(['or', 'and', 'with'], top) >= list_position(['or', 'and', 'with'], t) else false end, false) as pop
                  from (select *, tokens[k + 1] as t, ops[-1] as top from yard where not done))
        ),
        licensed as (select r, vals[1] as v from yard where done),
        found as (select r, label, base, {_WEIGHT} as weight from noted union all select r, unnest(v.labels), false, v.weight from licensed),
        g as (select r, coalesce(array_to_string(list_sort(list(distinct label) filter (where base)), ','), '') as base_labels, array_to_string(list_sort(list(distinct label)), ',') as labels, max(weight) as score from found group by r),
        b as (select r, count(*) as n_base, min(pos)::bigint as first_word, max(pos)::bigint as last_word from noted where base group by r)
        select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0::double) as score
        from w left join b using (r) left join g using (r)
    """,
    "op10_decontaminate": rf"""
        with i as (select row_number() over () as i, item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w from (select distinct item_id, text from benchmark where item_id is not null and text is not null)),
        c as (select *, len(w) as n, greatest(1, len(w) - greatest(1, len(w) // 4)) as cut from i where len(w) > 0),
        parts as (select i, unnest({_RUNS("w[1:cut + 4]")}) as s, true as q, false as a from c union all select i, unnest({_RUNS("(case when n - cut >= 5 then w[cut + 1:] else w[greatest(n - 4, 1):] end)")}), false, true from c),
        runs as (select i, s, bool_or(q) as q, bool_or(a) as a from parts group by i, s),
        size as (select i, count(*) as runs, count(*) filter (where q) as q, count(*) filter (where a) as a from runs group by i),
        d as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') as w from documents),
        have as (select distinct r, s from (select r, unnest({_RUNS("w")}) as s from d)),
        hit as (select r, i, count(*) as runs, count(*) filter (where q) as q, count(*) filter (where a) as a from have join runs using (s) group by r, i),
        long as (select r, i, hit.runs / size.runs as overlap, hit.q / size.q as question, hit.a / size.a as answer from hit join size using (i) join c using (i) where c.n >= 5),
        shorts as (select distinct n from c where n < 5),
        few as (select distinct r, n, s from (select r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as s from d, shorts)),
        pair as (select r, i, overlap, question, answer from long where overlap >= {decontaminate.SIMILAR}::double and question >= {decontaminate.PART}::double and answer >= {decontaminate.PART}::double
                 union all select r, c.i, 1, 1, 1 from few join c on few.n = c.n and few.s = array_to_string(c.w, ' ')),
        whole as (select count(*) as items, sum(n) / count(*) as mean, max(n) as step, floor({decontaminate.WIDE} * max(n))::bigint as width from c),
        tf as (select i, word, count(*) as tf from (select i, unnest(w) as word from c) group by i, word),
        df as (select word, count(*) as df from tf group by word),
        bm as (select i, word, ln(1 + (items - df + 0.5::double) / (df + 0.5::double)) * tf * ({decontaminate.K1}::double + 1) / (tf + {decontaminate.K1}::double * (1 - {decontaminate.B}::double + {decontaminate.B}::double * n / mean)) as part
               from tf join df using (word) join c using (i), whole),
        weights as (select i, sum(part) as total, min(part) as smallest, list(part order by part desc) as parts from bm group by i),
        theta as (select i, total, case when t > {decontaminate.LEAST}::double then t else smallest / total end as theta
                  from (select *, 1 - coalesce(list_sum(parts[1:floor((1 - {decontaminate.SIMILAR}::double) * runs + 1e-9)::bigint]), 0) / total as t from weights join size using (i))),
        met as (select r, unnest(w) as word, unnest(range(len(w))) as pos, len(w) as len from d where r in (select r from pair)),
        seen as (select p.r, p.i, m.word, m.pos, m.len, b.part from pair p join bm b on b.i = p.i join met m on m.r = p.r and m.word = b.word),
        inside as (select distinct r, i, word, part, unnest(range(greatest(0, ceil((pos - width + 1) / step))::bigint, least(pos // step, (greatest(1, len - width + step) - 1) // step)::bigint + 1)) as k from seen, whole),
        share as (select r, i, sum(part) as part from inside group by r, i, k),
        best as (select r, i, max(part / total) as score from share join theta using (i) where part / total >= theta * (1 - 1e-6) group by r, i),
        every as (select r, i, sum(part) / any_value(total) as score from (select distinct r, i, word, part from seen) join theta using (i) group by r, i)
        select d.doc_id, c.item_id, round(coalesce(best.score, every.score), 9) as score, pair.overlap::double as overlap, pair.question::double as question, pair.answer::double as answer
        from pair join d using (r) join c using (i) join every using (r, i) left join best using (r, i)
    """,
    "op5_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
        d as (select page_id, octet_length(payload) as n, sha256(payload) as digest from p),
        f as (select *, min(page_id) over (partition by digest) as first_id from d)
        select page_id, n::bigint as payload_bytes, digest as payload_digest,
               case when n >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
               case when n >= 100 and page_id <> first_id then first_id end as refers_to
        from f
    """,
    "op7_secrets": f"""
        with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
        f as ({_FOUND}),
        g as (select r, count(*) filter (where o = 0) as n_assign, count(*) filter (where o = 1) as n_access, count(*) filter (where o = 2) as n_hex,
                     string_agg(kind || ':' || start || ':' || (start + length(hit)), ',' order by start, o) filter (where o < 3) as base,
                     string_agg(kind || ':' || start || ':' || (start + length(hit)), ',' order by start, o) as spans from f group by r)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from d left join g using (r)
    """,
    "op9_shards": f"""
        with t as ({_CRC_TABLE}),
        d as (select row_number() over () as r, doc_id, coalesce(doc_id::varchar, '') as key, encode(coalesce(text, '')) as data, coalesce(text, '') as text from documents),
        c as (select r, doc_id, key, octet_length(data)::bigint + 8 as size, {_CRC} as text_crc32, ('0x' || substr(md5(key || '/' || md5(text)), 1, 13))::bigint % 512 as part from d, t),
        h as (select r, s, ('0x' || substr(md5(key || '/' || s), 1, 13))::bigint as draw from c, (select unnest(range(25)) as s)),
        b as (select r, arg_max(s, draw) filter (where s < 24) as shard, arg_max(s, draw) as grown from h group by r)
        select doc_id, size, text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by part, doc_id, text_crc32, size) - 1 as slot, grown::int as grown_shard
        from c join b using (r)
    """,
}
