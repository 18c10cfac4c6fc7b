"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat_format, decontamination, exact_dedup, line_crf, line_templates, prefix_trie, secret_scan, spelling, url_filters, warc
from sparkloom.llm import quality_rules as rules
from sparkloom.llm.common import materialise, shared_dir, table
from sparkloom.llm.near_duplicates import near_duplicates


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = rules.fit(docs, rules.trusted_rows(docs, labels))
    return rules.quality_rules(docs, weights).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    leaks = decontamination.contaminated(decontamination.matches(docs, benchmark))
    items = leaks.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("covered"))
    joined = docs.select("doc_id").join(items, "doc_id", "left")
    return joined.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("covered", F.lit(0)).alias("covered_tokens"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    spoken = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return spoken.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.written("base_spans").cast("binary"), 256).alias("base_sha256"),
        secret_scan.written("spans").alias("spans"),
    )


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = line_crf.score(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= line_crf.CUTOFF).cast("int").alias("predicted"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filters(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = materialise(warc.write(warc.planned(table(spark, sf_dir, "pages")), folder), "manifest")
    read = warc.read(manifest, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_templates.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text")
    read = chat_format.read_back(chat_format.chat_format(rows.union(planted)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(said).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.rebuilt(prefix_trie.said(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, by=("family", "conv_id"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    told = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), index)
    index.forget()
    return told.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


_OP4_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, chr(1))]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), chr(1))) end) as g from w
), n as (select doc_id, count(*) as n from s group by 1
), p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all
), e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 75 * (na.n + nb.n - k)
), both_ways as (select a, b from e union all select b, a from e
), reach(doc_id, here) as (select doc_id, doc_id from documents union select r.doc_id, t.b from reach r join both_ways t on r.here = t.a
), c as (select doc_id, min(here) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d join c using (doc_id) left join n using (doc_id)
"""

_OP7_SQL = r"""
with recursive rules(kind, rh, rp) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), tags as (
  select url, unnest(regexp_extract_all(array_to_string(list_transform(string_split(regexp_replace(html, '(?is)<script\b.*?(</script|\z)', '', 'g'), '<!--'),
      lambda part, i: case when i = 1 then part when contains(part, '-->') then substr(part, strpos(part, '-->') + 3) else '' end), ''), '(?is)<(?:link|meta)\b[^<>]*>')) as tag from pages where strpos(url, '://') > 0
), written as (
  select url, regexp_replace(case
      when regexp_matches(tag, '(?is)^<link\b.*[\s"'']rel\s*=\s*("[^"]*\bcanonical\b[^"]*"|''[^'']*\bcanonical\b[^'']*''|canonical\b)')
        then regexp_extract(tag, '(?is)[\s"'']href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1)
      when regexp_matches(tag, '(?is)^<meta\b.*[\s"'']http-equiv\s*=\s*["'']?\s*refresh\b')
        then regexp_extract(regexp_extract(tag, '(?is)[\s"'']content\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), '(?is)\burl\s*=\s*(.*)$', 1)
      else '' end, '^[\s"'']+|[\s"'']+$', '', 'g') as t
  from tags
), based as (
  select url, regexp_replace(t, '(?i)&(amp|#0*38|#x0*26);', '&', 'g') as t, split_part(url, '://', 1) || ':' as scheme,
    translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as h,
    regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) as p
  from written
), dotted as (
  select *, case when t like '/%' then t else '/' || regexp_extract(p, '^/(.*/)?', 1) || t end as q from based
), plain as (
  select *, regexp_extract(q, '^([^?#]*)', 1) as body, substr(q, length(regexp_extract(q, '^([^?#]*)', 1)) + 1) as more from dotted
), cleaned as (
  select *, case when contains(body, '/.') then
      list_reduce(string_split(body, '/'), lambda done, x: case when x = '.' then done when x = '..' then regexp_replace(done, '/[^/]*$', '') else done || '/' || x end)
      || case when string_split(body, '/')[-1] in ('.', '..') then '/' else '' end || more else q end as whole
  from plain
), resolved as (
  select url, case
      when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t
      when regexp_matches(t, '^([A-Za-z][A-Za-z0-9+.-]*:|#|$)') then null
      when t like '//%' then scheme || t
      when t like '?%' then scheme || '//' || h || p || t
      else scheme || '//' || h || whole end as target
  from cleaned
), named as (
  select u, translate(split_part(u, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as scheme,
    translate(regexp_extract(substr(u, strpos(u, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(u, strpos(u, '://') + 3), '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(substr(u, strpos(u, '://') + 3), '^[^/?#]*([^#]*)', 1) as tail
  from (select url as u from pages union select target from resolved) where strpos(u, '://') > 0
), judged as (
  select u, host, path, scheme || '://' || host || tail as node, arg_max(kind, length(rh || rp)) as kind, arg_max(rh || rp, length(rh || rp)) as rule
  from named left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by all
), edges as (
  select a.node as x, b.node as y from resolved r join judged a on a.u = r.url join judged b on b.u = r.target
), both_ways as (
  select x, y from edges union select y, x from edges
), reach(node, here) as (
  select x, x from both_ways union select r.node, b.y from reach r join both_ways b on r.here = b.x
), told as (
  select r.node, bool_or(j.kind = 'allow') as any_allow, bool_or(j.kind = 'block') as any_block from reach r join judged j on j.node = r.here group by 1
)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule,
  coalesce(kind, case when any_allow then 'allow' when any_block then 'block' end, 'allow') as verdict
from pages left join judged on u = url left join told using (node)
"""

_OP8_SQL = r"""
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select *, min(page_id) over (partition by payload_digest) as first from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and first < page_id then first end as refers_to
from f
"""

_OP10_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, len(regexp_extract_all(role || ' ' || text, '[<\[]\\*(/?s>|/?INST\])')) as n_controls from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<s>[INST]') + length(role) + length('[/INST]') + length(text) + length('</s>') + n_controls)::bigint as formatted_chars
from marked group by conv_id
"""


# CRC-32 by half bytes: fixed values of the polynomial 0xEDB88320.
_CRC = """{name} as (
  select s, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(hex(s)) + 1),
      lambda i: (instr('0123456789ABCDEF', substr(hex(s), i + (case when i % 2 = 1 then 1 else -1 end), 1)) - 1)::bigint)),
    lambda c, v: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, v) & 15) + 1]))) as h
  from ({rows})
)"""

_OP11_SQL = rf"""
with said as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i
  from conversations where conv_id is not null
), {_CRC.format(name="sums", rows="select distinct conv_id::varchar as s from said")}
, own as (
  select conv_id, list(struct_pack(role := role, text := text) order by i) as turns from said group by 1
), built as (
  select c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h % 4), list_slice(c.turns, h % 4 + 1, len(c.turns))) as turns
  from own c join sums on s = c.conv_id::varchar left join own b on b.conv_id = c.conv_id - c.conv_id % 20
), steps as (
  select conv_id, unnest(range(0, len(turns) + 1)) as depth, turns from built
), members as (
  select conv_id, depth, list_slice(turns, 1, depth) as node, case when depth > 0 then list_slice(turns, 1, depth - 1) end as above,
    depth = len(turns) as ends, case when depth = 0 then 0 else len(regexp_extract_all(turns[depth].text, '[^\x20\x09-\x0D]+')) end as words
  from steps
), nodes as (
  select node, depth, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from members group by 1, 2
), children as (
  select above, count(*) as n from nodes group by 1
), sized as (
  select nodes.*, coalesce(n, 0) as n_children from nodes left join children on children.above = node
), below as (
  select m.node, sum((s.n_children = 0)::bigint) as n_leaves, sum((s.n_convs - 1) * s.words)::bigint as saved_tokens
  from (select conv_id, depth, node from sized) o join members p on p.conv_id = o.conv_id and p.depth <= o.depth join members m on m.conv_id = o.conv_id and m.depth = p.depth
  join sized s on s.node = o.node group by 1
)
select s.conv_id, s.depth, p.conv_id as parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, s.ends_sha256
from sized s join below b on b.node = s.node left join nodes p on p.node = s.above
"""

_OP12_SQL = """
select doc_id, max(doc_id) over t as keep_id, count(*) over t as group_size, doc_id is not distinct from max(doc_id) over t as kept, sha256(coalesce(text, '')) as text_sha256
from documents window t as (partition by coalesce(text, ''))
"""

_OP13_SQL = rf"""
with recursive runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents
), counted as (
  select id || ':' || run as s, run, count(*) as n from runs where length(run) >= 5 group by all
), {_CRC.format(name="sums", rows="select s from counted")}
, spelt as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from counted join sums using (s)
), words as (
  select word, sum(n)::bigint as n from spelt where length(word) >= 5 group by 1 having sum(n) >= 3
), cuts as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as cut from (select word, n, unnest(range(0, length(word))) as i from words)
), near as (
  select a.word, b.word as other, b.n from cuts a join cuts b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on a.cut = b.word
  union select b.word, a.word, a.n from cuts a join words b on a.cut = b.word
), best as (
  select word, count(*) as n_near, min(struct_pack(less := -n, other := other)) as s from near group by 1
), forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when -s.less >= 2 * w.n then s.other end as form, case when -s.less >= 2 * w.n then -s.less end as form_n
  from words w left join best using (word)
), follow(word, here) as (
  select word, word from forms union all select follow.word, form from follow join forms f on f.word = here where form is not null
)
select f.word, f.form, here as root, f.n, f.n_near, f.form_n from forms f join follow on follow.word = f.word join forms g on g.word = here where g.form is null
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_rules": op1_quality_rules, "op2_decontamination": op2_decontamination, "op3_bpe": op3_bpe, "op4_minhash": op4_minhash, "op5_secret_scan": op5_secret_scan, "op6_line_crf": op6_line_crf, "op7_url_filters": op7_url_filters, "op8_warc": op8_warc, "op9_line_templates": op9_line_templates, "op10_chat_format": op10_chat_format, "op11_prefix_trie": op11_prefix_trie, "op12_exact_dedup": op12_exact_dedup, "op13_spelling": op13_spelling}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": _OP4_SQL, "op7_url_filters": _OP7_SQL, "op8_warc": _OP8_SQL, "op10_chat_format": _OP10_SQL, "op11_prefix_trie": _OP11_SQL, "op12_exact_dedup": _OP12_SQL, "op13_spelling": _OP13_SQL}
