"""The operators as queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import feedfold

from . import bpe, chatml, decontaminate, embeddings, licenses, merkle, minhash, quality, spelling, substrings, toxicity, urls, warc

cloudpickle.register_pickle_by_value(feedfold)

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op10_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("rest.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    decoded = bpe.decode(coded.select("rest.doc_id", "ids", F.sha2("raw", 256).alias("ids_sha256")), path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("rest.doc_id", toxicity.held_out("rest.doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("rest.doc_id", "item_id", "score", "question_overlap", "answer_overlap")


@query
def op3_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("intact")


ORACLES["op9_warc"] = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), d as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as hex,
    min(page_id) over (partition by payload) as first
  from p
), b as (
  select *, list_aggregate(
    [lpad(bin(strpos('0123456789abcdef', h) - 1), 4, '0') for h in string_split(hex, '')], 'string_agg', '') as bits
  from d
)
select page_id, payload_bytes::bigint as payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1
    + 16 * substr(bits, (5 * i + 1)::int, 1)::int + 8 * substr(bits, (5 * i + 2)::int, 1)::int
    + 4 * substr(bits, (5 * i + 3)::int, 1)::int + 2 * substr(bits, (5 * i + 4)::int, 1)::int
    + substr(bits, (5 * i + 5)::int, 1)::int)::int, 1) for i in range(32)], 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from b"""


#: Verdict, host and path of the rules that come before the model; fixed values.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"),
             ("allow", "net", "/de/"), ("block", "org", "/es/")]


@query
def op7_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.train(*urls.labelled_by_rules(pages, URL_RULES))
    return urls.judged(pages, URL_RULES, model).select("rest.page_id", "host", "path", "rule", "verdict", "score")


@query
def op1_license_scan(spark, sf_dir):
    found = licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("rest.doc_id", *[F.array_join(c, ",").alias(c) for c in ("sentences", "licenses", "unmatched")])


ORACLES["op1_license_scan"] = licenses.sql()


@query
def op4_chat_perspectives(spark, sf_dir):
    return chatml.perspectives(table(spark, sf_dir, "conversations"))


ORACLES["op4_chat_perspectives"] = chatml.SQL


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.scored(docs, table(spark, sf_dir, "labels"))
    return scored.select("rest.doc_id", quality.held_out("rest.doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Fields of a document's leaf, in order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*LEAF)
    one_more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
                      merkle.leaf_digest(*(one_more if c == "n_chars" else F.col(c) for c in LEAF)))
    rows = merkle.verified(merkle.manifest(docs, LEAF, claimed=tampered))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                       F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


# Unsigned crc32 of a list of bytes, for SQL that lacks it.
_CRC_TABLE = """crc as (
  select list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
    order by i) as t
  from (select unnest(range(256)) as i)
)"""


def _crc(some_bytes: str) -> str:
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {some_bytes}), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")


def _leaf(n_chars: str) -> str:
    parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in
             ("doc_id::varchar", "source", "lang", f"({n_chars})::varchar", "text")]
    return f"sha256({' || '.join(parts)})"


_DIGITS = "[unicode(x)::bigint for x in string_split(doc_id::varchar, '')]"

ORACLES["op13_merkle_manifest"] = f"""
with recursive {_CRC_TABLE}, d as (
  select doc_id, lang, {_leaf("n_chars")} as leaf, {_leaf("n_chars + 1")} as changed, {_crc(_DIGITS)} % 7 = 0 as tampered,
    row_number() over (partition by lang order by doc_id nulls first) - 1 as pos,
    count(*) over (partition by lang) as n, dense_rank() over (order by lang nulls first) - 1 as grp
  from documents, crc
), up(level, grp, pos, n, digest) as (
  select 0, grp, pos, n, leaf from d
  union all
  select level + 1, grp, pos // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' order by pos)) from up
  where n > 1 group by level, grp, pos // 2
), subs as (select grp, digest as subroot from up where n = 1),
top(level, pos, n, digest) as (
  select 0, grp, (select count(*) from subs), subroot from subs
  union all
  select level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' order by pos)) from top where n > 1 group by level, pos // 2
), down(doc_id, leaf, grp, level, pos, n, folded, proof) as (
  select doc_id, leaf, grp, 0, pos, n, case when tampered then changed else leaf end, '' from d
  union all
  select down.doc_id, down.leaf, down.grp, down.level + 1, down.pos // 2, (down.n + 1) // 2,
    sha256(case when down.pos % 2 = 0 then folded || coalesce(s.digest, '') else s.digest || folded end), proof || coalesce(s.digest, '')
  from down left join up s on s.level = down.level and s.grp = down.grp and s.pos = xor(down.pos, 1) where down.n > 1
), rise(doc_id, leaf, grp, level, pos, n, folded, proof) as (
  select doc_id, leaf, grp, 0, grp, (select count(*) from subs), folded, proof from down where n = 1
  union all
  select rise.doc_id, rise.leaf, rise.grp, rise.level + 1, rise.pos // 2, (rise.n + 1) // 2,
    sha256(case when rise.pos % 2 = 0 then folded || coalesce(s.digest, '') else s.digest || folded end), proof || coalesce(s.digest, '')
  from rise left join top s on s.level = rise.level and s.pos = xor(rise.pos, 1) where rise.n > 1
)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
from rise join subs using (grp), (select digest as root from top where n = 1) where rise.n = 1"""


_BYTES = ("flatten([case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end "
          "for x in string_split(doc_id::varchar || ':' || run, '')])")

ORACLES["op11_spelling_variants"] = r"""
with recursive CRC, runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents
), each as (
  select run, n, HASH as h from (select doc_id, run, count(*) as n from runs where length(run) >= 6 group by doc_id, run), crc
), typed as (
  select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from each
), w as (
  select word, sum(n)::bigint as n from typed where length(word) >= 6 group by word having sum(n) >= 5
), cut as (
  select word, n, k, substr(word, 1, k) || substr(word, k + 2) as rest from (select word, n, unnest(range(length(word)))::int as k from w)
), near as (
  select a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.k = b.k and a.word <> b.word
  union
  select c.word, c.n, w.word, w.n from cut c join w on c.rest = w.word
  union
  select w.word, w.n, c.word, c.n from cut c join w on c.rest = w.word
), best as (
  select word, count(*) as n_near, first(near order by near_n desc, near) as best, max(near_n) as best_n from near group by word
), f as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * w.n then best end as form, case when best_n >= 5 * w.n then best_n end as form_n
  from w left join best using (word)
), follow(word, root) as (
  select word, word from f union all select follow.word, f.form from follow join f on f.word = follow.root where f.form is not null
), last as (select follow.word, root from follow join f on f.word = follow.root where f.form is null)
select word, form, root, n, n_near, form_n from f join last using (word)""".replace("CRC", _CRC_TABLE).replace("HASH", _crc(_BYTES))


# What SQL can say of the rest; a text that begins with a raw string keeps its escapes.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLES["op3_embedding_near_dedup"] = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) as (
  select vec_id, vec_id from embeddings union select reach.a, links.b from reach join links on reach.b = links.a
), n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, min(b) as component_id, vec_id = min(b) as kept
from embeddings join reach on reach.a = vec_id left join n on n.a = vec_id group by vec_id, n"""

ORACLES["op6_minhash_near_dedup"] = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, {_WORDS}) as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as shingle
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as both_ from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id
), links as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_ >= 85 * (x.n + y.n - both_)
), reach(a, b) as (
  select doc_id, doc_id from documents union select reach.a, links.b from reach join links on reach.b = links.a
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, min(b) as component_id, d.doc_id = min(b) as kept
from documents d join reach on reach.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n"""

ORACLES["op10_substring_dedup"] = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) as ws from documents),
x as (
  select doc_id, i, array_to_string(ws[i : i + 19], ' ') as win
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20)
), f as (select doc_id, i, row_number() over (partition by win order by doc_id, i) as nth from x),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 20)) as p from f where nth > 1)),
placed as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as k, count(*) as n from placed
  where not exists (select 1 from gone where gone.doc_id = placed.doc_id and gone.p = placed.p) group by doc_id
)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(k, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id"""
