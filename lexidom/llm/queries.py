"""The registered queries of the numbered operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import table
from .decontaminate import contained
from .hard_negatives import mine_embeddings
from .language import held_out, identify
from .licenses import scan_licenses
from .lines import dedup_lines
from .mixing import mix
from .pages import extract
from .simhash import near_duplicates
from .spellings import group_spellings
from .substrings import remove_repeats
from .surrogates import anonymise
from .token_files import round_trip
from .topk import search_embeddings

#: Where the session names the secret of the surrogates; unset, they follow from a public word.
SURROGATE_KEY, PUBLIC_KEY = "spark.lexidom.surrogateKey", "surrogates of the documents table"


def op1_surrogates(spark, sf_dir) -> DataFrame:
    found = anonymise(table(spark, sf_dir, "documents"), spark.conf.get(SURROGATE_KEY, PUBLIC_KEY))
    return found.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), "entities")


def op2_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


def op3_language(spark, sf_dir) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op4_licenses(spark, sf_dir) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))

    def joined(labels):
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    base, near = F.col("places.label"), F.col("spans.label")
    closeness = F.transform("spans", lambda s: 1.0 - s["edits"] / 16.0)
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, near)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(closeness), F.lit(0.0))).alias("score"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )


def op5_lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint"))
    return dedup_lines(lines).select(
        "doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"),
        F.size("removed").cast("bigint").alias("n_removed"), "text",
    )


def op6_substrings(spark, sf_dir) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_pages(spark, sf_dir) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op8_mixing(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.col(f"mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken")]
    )


def op9_topk(spark, sf_dir) -> DataFrame:
    return search_embeddings(table(spark, sf_dir, "embeddings"))


def op10_decontaminate(spark, sf_dir) -> DataFrame:
    found = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


def op11_hard_negatives(spark, sf_dir) -> DataFrame:
    return mine_embeddings(table(spark, sf_dir, "embeddings"))


def op12_spellings(spark, sf_dir) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


def op13_token_files(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    read = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    n_tokens = (F.octet_length("ids") / 4).cast("bigint")
    return read.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_surrogates, op2_simhash, op3_language, op4_licenses, op5_lines,
        op6_substrings, op7_pages, op8_mixing, op9_topk, op10_decontaminate, op11_hard_negatives,
        op12_spellings, op13_token_files,
    )
}

_PLAIN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op5_lines": rf"""
with lines as (
  select doc_id, i - 1 as line_no, ls[i] as line
  from (select doc_id, string_split(text, chr(10)) ls from documents where text is not null),
    lateral (select unnest(range(1, len(ls) + 1)) as i)),
sets as (
  select doc_id, line_no, line,
    list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '{_PLAIN}'), lambda x: x <> ''))) as s
  from lines),
classes as (
  select s, len(s) as n, min((doc_id, line_no)) as pos, row_number() over () as c
  from sets where len(s) > 0 group by s),
words as (select c, n, pos, unnest(s) as w from classes),
df as (select w, count(*) as f from words group by w),
prefix as (
  select * from (select c, n, pos, w, row_number() over (partition by c order by f, w) as r from words join df using (w))
  where r <= n - ceil(n * 0.8 - 1e-9) + 1),
pairs as (
  select distinct a.c as later, b.c as earlier from prefix a join prefix b on a.w = b.w and b.pos < a.pos
  where b.n >= 0.8 * a.n - 1e-9 and a.n >= 0.8 * b.n - 1e-9),
alike as (
  select distinct later from (
    select later, a.n as na, b.n as nb, len(list_intersect(a.s, b.s)) as shared
    from pairs join classes a on a.c = later join classes b on b.c = earlier)
  where shared >= 0.8 * (na + nb - shared) - 1e-9),
marked as (
  select sets.*, classes.c is not null and (classes.c in (select later from alike) or (doc_id, line_no) <> pos) as gone
  from sets left join classes on sets.s = classes.s and len(sets.s) > 0)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
  case when d.text is null then null else coalesce(kept, '') end as text
from documents d left join (
  select doc_id, count(*) as n_lines, count_if(gone) as n_removed,
    string_agg(line, chr(10) order by line_no) filter (not gone) as kept
  from marked group by doc_id) using (doc_id)
""",
    "op6_substrings": rf"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
windows as (
  select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) as h
  from texts, lateral (select unnest(range(1, len(ws) - 33)) as i)),
repeated as (select h from windows group by h having count(*) > 1),
words as (
  select doc_id, i, ws[i] as w, max(case when r.h is null then 0 else 1 end)
    over (partition by doc_id order by i rows between 34 preceding and current row) as gone
  from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from texts)
  left join windows using (doc_id, i) left join repeated r using (h))
select doc_id, len(ws) as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from texts left join (
  select doc_id, sum(gone) as n_removed, string_agg(w, ' ' order by i) filter (gone = 0) as kept
  from words group by doc_id) using (doc_id)
""",
    "op8_mixing": rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as size,
    ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, '-'), md5(coalesce(text, '')))), 1, 14))::bigint as place
  from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, [5, 2, 1][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight,
    row_number() over (order by source is null, source) as rank, source_size * 2 as lim,
    (sum(source_size) over ())::bigint::double * 1.5::double as budget
  from sources),
run as (
  select *, lim * ((sum(weight) over ()) - coalesce(sum(weight) over w, 0))
    <= weight * (budget - coalesce(sum(lim) over w, 0)) as whole
  from ranked window w as (order by lim::double / weight, rank rows between unbounded preceding and 1 preceding)),
level as (
  select (any_value(budget) - (coalesce(sum(lim) filter (whole), 0))::bigint)
    / nullif(coalesce(sum(weight) filter (not whole), 0), 0)::double as level from run),
targets as (
  select source, source_size, case when whole then lim::double else level * weight end as target from run, level),
passes as (
  select *, case when source_size = 0 then 0 when target >= 2 * source_size then 2
    when target >= source_size then 1 else 0 end as p from targets)
select doc_id, size, source_size, target,
  size * (p + case when (sum(size) over (partition by s.source order by place))::bigint
    <= target - p * source_size then 1 else 0 end) as taken
from sized s join passes t on s.source is not distinct from t.source
""",
    "op9_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as q
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as query_id, b.vec_id,
    coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0)
select query_id, rank::integer as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 10
""",
    "op10_decontaminate": rf"""
with texts as (
  select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark),
words as (
  select kind, id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_PLAIN}'), lambda x: x <> '') as ws
  from texts),
shingles as (
  select distinct kind, id, array_to_string(ws[i:i + 4], ' ') as s
  from words, lateral (select unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) as i)),
items as (select id as item_id, s, count(*) over (partition by id) as n_item from shingles where kind = 'i'),
met as (
  select id as doc_id, item_id, n_item, count(*) as n_shared
  from items join shingles using (s) where kind = 'd' group by all)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from met
where n_shared >= ceil(n_item * 0.8 - 1e-9)
""",
    "op11_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
  (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::integer as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
""",
    "op12_spellings": r"""
with recursive crc as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::bigint, range(8)),
      lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) r(i))),
runs as (
  select coalesce(doc_id::varchar, '') || ':' || run as name, run from (
    select doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) as run
    from documents)),
hashed as (
  select run, count(*) as n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(1, 2 * octet_length(encode(name)), 2), lambda i: ('0x' || substr(hex(encode(name)), i, 2))::bigint)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) as h
  from runs, crc group by name, run, t),
slipped as (
  select n, case when h % 31 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word from hashed),
words as (
  select word, sum(n)::bigint as n from slipped where length(word) >= 7 group by word having sum(n) >= 2),
cuts as (
  select word, n, i, word[:i - 1] || word[i + 1:] as rest
  from words, lateral (select unnest(range(1, length(word) + 1)) as i)),
near as (
  select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select c.word, w.word, w.n from cuts c join words w on c.rest = w.word
  union select w.word, c.word, c.n from cuts c join words w on c.rest = w.word),
best as (
  select word, count(*) as n_near, max(near_n) as top, first(near order by near_n desc, near) as near from near group by word),
known as (
  select word, n, coalesce(n_near, 0) as n_near, case when top >= 10 * n then near end as form,
    case when top >= 10 * n then top end as form_n
  from words left join best using (word)),
up as (
  select word, word as root from known where form is null
  union all select k.word, up.root from known k join up on k.form = up.word)
select word, form, root, n, n_near, form_n from known join up using (word)
""",
}
