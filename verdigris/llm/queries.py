"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import classifier, decontaminate, divergence, lm, mixing, ngram_join, pii, quality, secrets, shards, spelling, store, toolcalls


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.linked(*toolcalls.exchanges(spark.read.parquet(f"{sf_dir}/conversations.parquet")), toolcalls.ANSWER)


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.trained_and_scored(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shards.histogram_sort(documents(spark, sf_dir))
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = quality.judged(documents(spark, sf_dir), carry=["doc_id"])
    return j.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stored(documents(spark, sf_dir), store.default_tokenizer())


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_tool_calls, op2_kneser_ney, op3_pii, op4_histogram_sort, op5_secrets, op6_mixing, op7_host_rules, op8_decontamination, op9_content_store, op10_ngram_join, op11_source_divergence, op12_quality_classifier, op13_spelling_variants)}

OP7_MEASURES = r"""
t as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (select r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) as g from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
d as (select r, i from g qualify count(*) over (partition by r, g) > 1),
p as (select r, count(distinct i + k) as n from d, (values (0), (1), (2)) as v(k) group by r),
m as (select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines,
        cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(p.n, 0) as bigint) as n_repeat_words from w left join p using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 100 * n_symbols > 30 * n_words as symbols_failed,
        100 * n_dup_lines > 50 * n_lines as lines_failed, word_chars < 2 * n_words or word_chars > 15 * n_words as length_failed from m)"""


def _op7_sql() -> str:
    low, high = quality.LIMITS
    severity = {"symbols": "100 * n_symbols / (30 * greatest(n_words, 1))", "lines": "100 * n_dup_lines / (50 * greatest(n_lines, 1))", "length": "greatest(2 * n_words / greatest(word_chars, 1), word_chars / (15 * greatest(n_words, 1)))"}
    parts, prior, rates, limits, stay = [], [], [], [], []
    for r in quality.RULES:
        parts.append(f"count(*) filter ({r}_failed) as {r}_f")
        s = f"sum({r}_f) / sum(docs)"
        v = f"sum({r}_f * {r}_f / docs) / sum(docs) - ({s}) * ({s})"
        prior.append(f"{s} as {r}_m, case when {v} > 1e-12 then greatest(1.0, ({s}) * (1 - {s}) / ({v}) - 1) end as {r}_s")
        rates.append(f"({r}_f + {r}_m * {r}_s) / (docs + {r}_s) as {r}_r")
        odds = f"({r}_m / (1 - {r}_m) / ({r}_r / (1 - {r}_r)))"
        limits.append(f"case when {r}_s is null then 1.0 else least({high}, greatest({low}, {' * '.join([odds] * quality.EVIDENCE)})) end as {r}_limit")
        stay.append(f"{severity[r]} <= {r}_limit")
    return f"""with {OP7_MEASURES.strip()},
h as (select source, cast(count(*) as double) as docs, {', '.join(parts)} from f group by source),
a as (select {', '.join(prior)} from h),
s as (select source, a.*, {', '.join(rates)} from h, a),
v as (select source, {', '.join(limits)} from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {' and '.join(stay)} as kept
from f join v on f.source is not distinct from v.source"""


OP1_SQL = r"""
with u as (select conv_id, turn, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w from conversations where role = 'user'),
n as (select u.*, u.w % 15 = 0 as knot, u.w % 7 = 0 and u.w % 5 <> 0 and x.turn is not null as waits, x.turn as next_turn, x.w % 15 = 0 as next_knot, x.w % 5 = 0 as next_late
  from u left join u x on x.conv_id = u.conv_id and x.turn = u.turn + 2),
c as (select conv_id, turn, concat(conv_id, ':', turn) as call_id, 'answer' as name, turn as order_turn, case when w % 5 = 0 and not knot then 1 else 0 end as order_step, knot as cyclic,
    case when length(text) > 200 then '$.text: length' when w < 1 then '$.words: range' end as fault, concat('{"text":', to_json(text), ',"words":', w, '}') as arguments from n
  union all
  select conv_id, turn, concat(conv_id, ':', turn, ':note'), 'note', case when waits and not next_knot then next_turn else turn end,
    case when knot or waits and next_knot then 0 when waits then case when next_late then 2 else 1 end when w % 3 = 0 then 1 else 0 end, knot or waits and next_knot,
    case when w % 2 <> 0 then '$.even: enum' when length(text) > 150 then '$.length: range' end, concat('{"even":', w % 2 = 0, ',"length":', length(text), '}') from n),
r as (select conv_id, call_id, min(turn) as turn, arg_min(text, (turn, text)) as content, count(*) as n
  from (select conv_id, turn, text, case role when 'user' then concat(conv_id, ':', turn - 2, ':note') else concat(conv_id, ':', turn - 1) end as call_id from conversations where role in ('user', 'assistant')) group by 1, 2)
select coalesce(c.conv_id, r.conv_id) as conv_id, c.turn, coalesce(c.call_id, r.call_id) as call_id, c.name,
  case when c.call_id is null then 'orphan' when r.call_id is null then 'unanswered' when r.turn < c.turn then 'early' else 'linked' end as status, r.turn as result_turn, coalesce(r.n, 0) as n_results,
  c.order_turn, cast(c.order_step as integer) as order_step, c.cyclic, c.fault,
  concat('{"arguments":', coalesce(c.arguments, 'null'), ',"id":"', coalesce(c.call_id, r.call_id), '","name":', case when c.call_id is null then 'null' else concat('"', c.name, '"') end,
    ',"result":', case when r.call_id is null then 'null' else concat('{"content":', to_json(content), ',"turn":', r.turn, '}') end, '}') as json
from c full join r on c.conv_id = r.conv_id and c.call_id = r.call_id
"""

OP10_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(lower_ascii, '[^\x20\x09-\x0D]+') as w from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)),
s as (select distinct doc_id, md5(concat_ws(' ', w[i], w[i + 1], w[i + 2])) as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)
  union select doc_id, md5(array_to_string(w, ' ')) from w where len(w) between 1 and 2),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both_have from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_have >= 90 * (x.n + y.n - both_have)),
e as (select a, b from l union select b, a from l),
c as (select doc_id, doc_id as node from n union select c.doc_id, e.b from c join e on e.a = c.node)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.low, w.doc_id) as component_id from w left join n using (doc_id) left join (select doc_id, min(node) as low from c group by doc_id) m using (doc_id)
"""

#: Every alignment of which three words in a row agree, and in it every stretch; no stretch of LEAST words or more of which
#: four fifths agree, and no whole item of SHORTEST words or more, is without three such words.
OP8_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
i as (select * from (select row_number() over () as s, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as v from benchmark) where len(v) >= {decontaminate.SHORTEST}),
g as (select r, p, concat_ws(' ', w[p + 1], w[p + 2], w[p + 3]) as g from (select r, w, unnest(range(0, len(w) - 2)) as p from d)),
h as (select s, p, concat_ws(' ', v[p + 1], v[p + 2], v[p + 3]) as g from (select s, v, unnest(range(0, len(v) - 2)) as p from i)),
c as (select distinct r, s, g.p - h.p as shift from g join h on g.g = h.g),
x as (select r, s, shift, q, w[q + 1] = v[q - shift + 1] as same, len(v) as n from (select c.r, c.s, shift, w, v, unnest(range(greatest(0, shift), least(len(w), shift + len(v)))) as q from c join d on d.r = c.r join i on i.s = c.s)),
t as (select r, s, shift, q + 1 as at, sum(case when same then 1 else -4 end) over o as t, sum(same::int) over o as e from x where n >= {decontaminate.LEAST} window o as (partition by r, s, shift order by q)
  union all select r, s, shift, min(q), 0, 0 from x where n >= {decontaminate.LEAST} group by 1, 2, 3),
l as (select y.r, y.s, y.shift, y.at as b, min(z.at) as a, any_value(y.e) - arg_min(z.e, z.at) as e from t y join t z on y.r = z.r and y.s = z.s and y.shift = z.shift and z.at < y.at and z.t <= y.t group by 1, 2, 3, 4),
k as (select r, s, b - a as n, e, a from (select *, row_number() over (partition by r, s, shift order by b - a desc, b) as rn from l) where rn = 1 and b - a >= {decontaminate.LEAST}
  union all select r, s, n, n, shift from x where n < {decontaminate.LEAST} group by r, s, shift, n having count(*) = n and bool_and(same)),
m as (select doc_id, item_id, max({{'n': n, 'e': e, 'w': -a}}) as m from k join d on d.r = k.r join i on i.s = k.s group by 1, 2)
select doc_id, cast(item_id as bigint) as item_id, cast(m.n as bigint) as n_words, cast(m.e as bigint) as n_equal, cast(-m.w as bigint) as doc_word from m
"""

OP11_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
o as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, cast(count(*) as bigint) as n from o group by 1, 2 having count(distinct r) >= 10),
c as (select lang, source, term, cast(count(*) as bigint) as n from o semi join k using (lang, term) group by 1, 2, 3),
g as (select lang, source, coalesce(sum(n), 0)::hugeint as total from (select distinct lang, source from d) left join c using (lang, source) group by 1, 2),
l as (select lang, count(*) as terms, sum(n)::hugeint as total from k group by 1),
p as (select lang, source, term, coalesce(c.n, 0) as n, cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.terms) as bigint) as p from g join k using (lang) join l using (lang) left join c using (lang, source, term)),
q as (select lang, term, cast(1 + (1000000000::hugeint * (k.n + 2)) // (l.total + 2 * l.terms) as bigint) as q from k join l using (lang)),
x as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as v from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
u as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(v, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from p join q using (lang, term) where n > 0 and p > q),
n as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from u)
select lang, source, part, item, value, rank from n where part = 'pair' or rank <= 10
"""

#: CRC-32 by its table, bytes from code points: those of the runs beyond ASCII all begin with 195.
OP13_SQL = r"""
with recursive t as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from (select unnest(range(0, 256)) as i)),
d as (select row_number() over () as r, coalesce(cast(doc_id as varchar), '') as doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
o as (select r, doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from d),
c as (select r, doc_id, run, count(*) as n from o where length(run) >= 7 group by 1, 2, 3),
b as (select run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195, unicode(x)::bigint - 64] end)) as b from c),
h as (select run, n, xor(4294967295, list_reduce(b, lambda crc, x: xor(crc >> 8, t.t[(xor(crc, x) & 255) + 1]), 4294967295::bigint)) as h from b, t),
w as (select case when h % 31 = 0 then concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) else run end as w, n from h),
l as (select w, cast(sum(n) as bigint) as n from w where length(w) >= 7 group by 1 having sum(n) >= 2),
x as (select w, i, concat(substr(w, 1, i), substr(w, i + 2)) as less from (select w, unnest(range(0, length(w))) as i from l)),
e as (select x.w as a, y.w as b from x join x y on x.i = y.i and x.less = y.less and x.w <> y.w union select x.w, l.w from x join l on x.less = l.w union select l.w, x.w from x join l on x.less = l.w),
m as (select a, count(*) as n_near, arg_min(b, {'n': -l.n, 'w': b}) as best, max(l.n) as best_n from e join l on l.w = e.b group by a),
f as (select l.w, l.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * l.n then best end as form, case when best_n >= 10 * l.n then best_n end as form_n from l left join m on m.a = l.w),
g(w, place, steps) as (select w, w, 0 from f union all select g.w, f.form, steps + 1 from g join f on f.w = g.place where f.form is not null)
select f.w as word, form, root.place as root, n, n_near, form_n from f join (select w, arg_max(place, steps) as place from g group by w) root on root.w = f.w
"""

ORACLE_SQL = {"op13_spelling_variants": OP13_SQL, "op11_source_divergence": OP11_SQL, "op8_decontamination": OP8_SQL, "op1_tool_calls": OP1_SQL, "op10_ngram_join": OP10_SQL, "op7_host_rules": _op7_sql()}
