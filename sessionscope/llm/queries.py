"""Registered queries of the training-data operators, each over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from sessionscope.llm import bytepair
from sessionscope.llm.boilerplate import extract_main_text
from sessionscope.llm.decontaminate import find_contamination
from sessionscope.llm.jaccard import link_groups
from sessionscope.llm.langid import held_out, identify, train
from sessionscope.llm.mixing import mix
from sessionscope.llm.preference import format_pairs, mask, pairs_from_conversations
from sessionscope.llm.prefixtrie import first_turns, later_turns, prefix_nodes, turn_sequences
from sessionscope.llm.quality import judge
from sessionscope.llm.resample import resample
from sessionscope.llm.substring import remove_repeats
from sessionscope.llm.urllists import evaluate, history_from_pages
from sessionscope.llm.warc import build_derivatives, responses_from_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


OP2_SQL = r"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select r, doc_id, i, array_to_string(w[i:i + 19], ' ') as run
  from (select r, doc_id, w, unnest(range(1, len(w) - 18)) as i from docs where len(w) >= 20)),
late as (select r, i from windows qualify row_number() over (partition by run order by doc_id, i) > 1),
gone as (select r, count(distinct p) as n, list(distinct p) as places from (select r, unnest(range(i, i + 20)) as p from late) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string(case when n is null then w else list_filter(w, lambda x, i: not list_contains(places, i)) end, ' ')) as kept_sha256
from docs left join gone using (r)
"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP3_SQL = r"""
with items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
grams as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from items where len(w) > 0)),
docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
places as (
  select r, k, i, array_to_string(w[i:i + k - 1], ' ') as gram
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from docs cross join (select distinct k from grams))),
found as (select r, k, i, item_id from places join grams using (k, gram)),
hit as (select r, count(distinct p) as n from (select r, unnest(range(i, i + k)) as p from found) group by r),
named as (select r, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct r, item_id::varchar as id from found where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
"""

def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = format_pairs(*pairs_from_conversations(_table(spark, sf_dir, "conversations")))
    return pairs.withColumns({"chosen_segments": mask(F.col("chosen_segments")), "rejected_segments": mask(F.col("rejected_segments"))})


OP4_SQL = r"""
with ordered as (
  select conv_id as pair_id, turn, role, text, row_number() over w as place, count(*) filter (role = 'assistant') over (w rows unbounded preceding) as nth,
    count(*) filter (role = 'assistant') over (partition by conv_id) as answers, first_value(text) over w as opening, ('0x' || substr(md5(conv_id::varchar), 1, 7))::bigint as number
  from conversations where conv_id is not null window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)),
picked as (select *, min(place) filter (role = 'assistant' and nth = number % greatest(answers, 1) + 1) over (partition by pair_id) as spot from ordered),
sides as (
  select pair_id, 'c' as side, turn, role, text from picked
  union all select pair_id, 'r', turn, role, case when place = spot then opening else text end from picked where spot is null or place <= spot or (number // 16) % 2 = 0),
placed as (
  select *, row_number() over (partition by pair_id, side order by turn nulls first, role nulls first, text nulls first) as k,
    '<|' || coalesce(role, '') || chr(124) || '>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as shown
  from sides),
together as (
  select coalesce(c.pair_id, r.pair_id) as pair_id, coalesce(c.k, r.k) as k, c.k is not null and r.k is not null and c.role is not distinct from r.role and c.text is not distinct from r.text as same
  from (select * from placed where side = 'c') c full join (select * from placed where side = 'r') r on c.pair_id = r.pair_id and c.k = r.k),
cut as (select pair_id, coalesce(min(k) filter (not same) - 1, count(*)) as n from together group by pair_id)
select pair_id, n::int as n_prompt_turns, coalesce(string_agg(shown, '' order by k) filter (side = 'c' and k <= n), '') as prompt,
  coalesce(string_agg(shown, '' order by k) filter (side = 'c' and k > n), '') as chosen, coalesce(string_agg(shown, '' order by k) filter (side = 'r' and k > n), '') as rejected,
  coalesce(string_agg(case when role = 'assistant' then 't' else 'm' end || length(shown), ',' order by k) filter (side = 'c' and k > n), '') as chosen_segments,
  coalesce(string_agg(case when role = 'assistant' then 't' else 'm' end || length(shown), ',' order by k) filter (side = 'r' and k > n), '') as rejected_segments,
  coalesce(sum(length(shown)) filter (side = 'c' and k > n and role = 'assistant'), 0)::bigint as chosen_trained_chars,
  coalesce(sum(length(shown)) filter (side = 'r' and k > n and role = 'assistant'), 0)::bigint as rejected_trained_chars,
  count(*) filter (side = 'c' and k > n and role = 'assistant') > 0 and count(*) filter (side = 'r' and k > n and role = 'assistant') > 0 as usable
from placed join cut using (pair_id) group by pair_id, n
"""


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with recursive mass as (select source, sum(length(coalesce(text, '')))::double as mass from documents group by source),
rates as (select source, sqrt(mass) * ((select sum(mass) from mass) / (select sum(sqrt(mass)) from mass)) / mass as mean from mass where mass > 0),
steps(source, mean, k, p, c) as (
  select source, mean, 0, exp(-mean), exp(-mean) from rates
  union all select source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from steps where k < ceil(mean + 12 * sqrt(mean) + 40)),
drawn as (
  select d.*, coalesce(d.doc_id::varchar, md5(coalesce(d.text, ''))) as own, (select count(*) from steps s where s.source is not distinct from d.source
    and s.c < (('0x' || substr(md5('11|' || coalesce(d.doc_id::varchar, md5(coalesce(d.text, '')))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) as n
  from documents d where exists (select 1 from rates r where r.source is not distinct from d.source))
select * exclude (n, own), ('0x' || substr(md5('11|' || copy || '|' || own), 1, 15))::bigint as shuffle_key
from (select *, unnest(range(1, n + 1))::int as copy from drawn)
"""


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_derivatives(responses_from_pages(_table(spark, sf_dir, "pages")))


def op7_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents")).drop("failed_rule")


OP6_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
grams as (select r, i, w[i:i + 2] as gram from (select r, w, unnest(range(1, len(w) - 1)) as i from docs where len(w) >= 3)),
again as (select r, i from grams qualify count(*) over (partition by r, gram) > 1),
repeats as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from again) group by r),
counted as (
  select doc_id, body, lines, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(repeats.n, 0) as n_repeat_words, w
  from docs left join repeats using (r)),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    10 * n_symbols > n_words or (n_dup_lines >= 3 and 10 * n_dup_lines > 3 * len(lines)) or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 10 * len(regexp_extract_all(body, '\p{Lu}')) > 4 * word_chars or 10 * len(regexp_extract_all(body, '!')) > 4 * n_words
    or 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(lines)
    or 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•‣]'))) > 9 * len(lines)
    or 10 * len(list_filter(w, lambda x: not regexp_matches(x, '\p{L}'))) > 5 * n_words as rejected
  from counted)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  base_failed, not base_failed and not rejected as kept
from judged
"""


def op9_url_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(*history_from_pages(_table(spark, sf_dir, "pages")))


OP9_SQL = r"""
with captures as (
  select page_id, url, (date '2024-01-01' + (page_id * 37 % 366)::int)::date as fetched,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') as host
  from pages),
hosts as (select distinct host from captures where length(host) <= 253),
drawn as (
  select host as pattern, ('0x' || substr(md5(host), 1 + 7 * part, 7))::bigint as n from hosts cross join range(3) t(part)
  union all select regexp_replace(host, '^[^.]*\.', ''), ('0x' || substr(md5(regexp_replace(host, '^[^.]*\.', '')), 1, 7))::bigint from hosts
  union all select url, ('0x' || substr(md5(url), 1, 7))::bigint from captures where page_id % 17 = 0 and url is not null),
daily as (
  select pattern, (date '2024-01-01' + ((n // 3) % 366)::int)::date as listed, min(n % 3) as action from drawn group by all),
held as (select *, lead(listed) over (partition by pattern order by listed) as until from daily),
hits as (
  select c.url, c.fetched, h.*, row_number() over (partition by c.url, c.fetched order by pattern = c.url desc, length(pattern) desc) as place
  from (select distinct url, fetched, host from captures) c join held h
    on (h.pattern = c.url or h.pattern = c.host or ends_with(c.host, '.' || h.pattern)) and c.fetched >= listed and (until is null or c.fetched < until) and action < 2)
select c.page_id, c.url, c.fetched, case action when 0 then 'block' when 1 then 'allow' else 'none' end as decision, pattern, listed
from captures c left join hits h on c.url = h.url and c.fetched = h.fetched and place = 1
"""


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
with recursive docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select distinct r, array_to_string(w[i:i + 4], ' ') as shingle
  from (select r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from docs where len(w) > 0)),
sizes as (select r, count(*) as n from sets group by r),
common as (select a.r as a, b.r as b, count(*) as n_both from sets a join sets b on a.shingle = b.shingle and a.r <> b.r group by all),
links as (select a, b from common join sizes x on a = x.r join sizes y on b = y.r where 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach(a, b) as (select r, r from docs union select reach.a, links.b from reach join links on reach.b = links.a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, min(o.doc_id) as component_id
from docs d left join sizes on d.r = sizes.r join reach on reach.a = d.r join docs o on o.r = reach.b group by d.r, d.doc_id, n
"""


def op11_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bytepair.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = bytepair.decode(bytepair.encode(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN), vocabulary)
    return tokens.select("doc_id", bytepair.n_tokens(F.col("ids")).alias("n_tokens"),
                         F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = turn_sequences(_table(spark, sf_dir, "conversations"))
    family, taken = F.col("conv") - F.col("conv") % 100, F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(6)).cast("int")
    opening = own.where(F.col("conv") % 100 == 0).select(F.col("conv").alias("family"), first_turns(F.col("seq"), 5).alias("opening"))
    rebuilt = own.withColumn("family", family).join(opening, "family", "left").select(
        "conv", F.concat(F.coalesce(first_turns(F.col("opening"), taken), F.unhex(F.lit(""))), later_turns(F.col("seq"), taken)).alias("seq"))
    return prefix_nodes(rebuilt)


OP12_SQL = r"""
with turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null),
ids as (
  select c, c - c % 100 as base, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(c::varchar) + 1), lambda i: ord(substr(c::varchar, i, 1))::bigint)),
    lambda a, b: list_reduce(list_concat([xor(a::bigint, b::bigint)], range(8)), lambda x, _: case when x % 2 = 1 then xor((x // 2)::bigint, 3988292384::bigint) else x // 2 end)), 4294967295::bigint) % 6 as h
  from (select distinct c from turns)),
rebuilt as (
  select ids.c, 0 as part, k, role, text from ids join turns on turns.c = base and k <= h
  union all select ids.c, 1, k, role, text from ids join turns on turns.c = ids.c and k > h),
steps as (
  select c, row_number() over w as d, length(text) as chars, string_agg(md5(length(role) || ':' || role || text), '') over w as path
  from rebuilt window w as (partition by c order by part, k rows between unbounded preceding and current row)),
member as (select c, d, chars, path from steps union all select c, 0, 0, '' from ids),
depths as (select c, max(d) as full_depth from member group by c),
node as (
  select path, any_value(d) as depth, any_value(chars) as chars, min(c) as conv_id, count(*) as n_convs, any_value(left(path, length(path) - 32)) as above,
    string_agg(c::varchar, ',' order by c) filter (d = full_depth) as ends
  from member join depths using (c) group by path),
kids as (select above, count(*) as n from node where depth > 0 group by above),
below as (select path, above as anc_path from (select distinct d.path, a.path as above from member d join member a on a.c = d.c and a.d <= d.d)),
sums as (
  select anc_path, sum((n_convs - 1) * chars) as saved, count(*) filter (k.n is null) as leaves
  from below join node on node.path = below.path left join kids k on k.above = node.path group by anc_path)
select x.conv_id, x.depth, up.conv_id as parent_conv_id, x.n_convs, coalesce(kids.n, 0) as n_children, leaves as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(x.ends, '')) as ends_sha256
from node x left join node up on x.depth > 0 and up.path = x.above left join kids on kids.above = x.path join sums on sums.anc_path = x.path
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
  from benchmark where text is not null),
found as (select r, word, count(*) as n from (select r, unnest(w) as word from docs) group by all),
spelled as (select distinct word, hex(word) as hex from (select word from found union all select word from items)),
bucket as (
  select word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(hex), 2), lambda i: ('0x' || substr(hex, i, 2))::bigint)),
    lambda a, b: list_reduce(list_concat([xor(a::bigint, b::bigint)], range(8)), lambda x, _: case when x % 2 = 1 then xor((x // 2)::bigint, 3988292384::bigint) else x // 2 end)), 4294967295::bigint) % 10000 as b
  from spelled),
corpus as (select b, sum(n) as s from found join bucket using (word) group by b),
target as (select b, count(*) as t from items join bucket using (word) group by b),
gains as (
  select range as b, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from corpus) + 10000)::double)
    / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from target) + 10000)::double)))::bigint as gain
  from range(10000) left join corpus on range = corpus.b left join target on range = target.b),
weights as (select r, sum(n * gain)::bigint as weight from found join bucket using (word) join gains using (b) group by r),
scored as (
  select doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint::double + 0.5) / 4294967296)))::bigint as score
  from docs left join weights using (r)),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank
from placed
"""


#: name -> (query, DuckDB SQL or None)
QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_substring_dedup": (op2_substring_dedup, OP2_SQL),
    "op3_benchmark_decontamination": (op3_benchmark_decontamination, OP3_SQL),
    "op4_preference_format": (op4_preference_format, OP4_SQL),
    "op5_warc_derivatives": (op5_warc_derivatives, None),
    "op7_host_suffix_array": (op7_host_suffix_array, None),
    "op8_poisson_mixing": (op8_poisson_mixing, OP8_SQL),
    "op6_quality_cascade": (op6_quality_cascade, OP6_SQL),
    "op9_url_list_join": (op9_url_list_join, OP9_SQL),
    "op10_ngram_jaccard_join": (op10_ngram_jaccard_join, OP10_SQL),
    "op11_segment_tree_bpe": (op11_segment_tree_bpe, None),
    "op12_prefix_trie": (op12_prefix_trie, OP12_SQL),
    "op13_importance_resampling": (op13_importance_resampling, OP13_SQL),
}
