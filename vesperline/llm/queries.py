"""One thin query for each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesperline.llm import alignment, embeddings, language, media, merkle, packing, phrase_dedup, secret_scan, sentence_pieces, simhash, suffix_dedup, toxicity, wrappers
from vesperline.llm._spark import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).drop("found")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_dedup.remove_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.train(docs))
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_sentence_pieces": op2_sentence_pieces,
        "op3_embeddings": op3_embeddings,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_simhash": op5_simhash,
        "op6_toxicity": op6_toxicity,
        "op7_secrets": op7_secrets,
        "op8_media": op8_media,
        "op9_html": op9_html,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_merkle": op11_merkle,
        "op12_alignment": op12_alignment,
        "op13_language": op13_language,
    }


_EMBEDDINGS = """
with recursive v as (select row_number() over () as r, vec_id, embedding::double[] as e from embeddings),
ok as (select * from v where len(e) > 0 and list_count(e) = len(e) and list_bool_and(list_transform(e, lambda x: isfinite(x))) and list_sum(list_transform(e, lambda x: x * x)) > 0),
links as (select a.r as a, b.r as b from ok a join ok b on a.r <> b.r and case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) >= 0.9 else false end),
reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
n as (select a, count(*) as n_links from links group by a),
least as (select reach.a, min(o.vec_id) as low from reach join v o on o.r = reach.b group by reach.a)
select v.vec_id, coalesce(n.n_links, 0) as n_links, least(v.vec_id, coalesce(least.low, v.vec_id)) as component_id, v.vec_id = least(v.vec_id, coalesce(least.low, v.vec_id)) as kept
from v left join n on n.a = v.r left join least on least.a = v.r"""

_BYTES = """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
p as (select doc_id, unnest(range(1, octet_length(b) + 1)) as i from d),
s as (select p.doc_id, p.i, case when p.i + 99 <= octet_length(d.b) then md5(array_slice(d.b, p.i, p.i + 99)) end as h, hex(array_slice(d.b, p.i, p.i)) as byte from p join d on d.doc_id = p.doc_id),
r as (select *, h is not null and row_number() over (partition by h order by doc_id, i) > 1 as again from s),
c as (select *, coalesce(max(case when again then i end) over (partition by doc_id order by i rows between 99 preceding and current row), 0) > 0 as gone from r),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from c),
t as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans, sha256(unhex(coalesce(string_agg(byte, '' order by i) filter (not gone), ''))) as kept from e group by doc_id)
select d.doc_id, octet_length(d.b) as n_bytes, coalesce(t.n_removed, 0) as n_removed, coalesce(t.n_spans, 0) as n_spans, coalesce(t.kept, sha256('')) as kept_sha256 from d left join t on t.doc_id = d.doc_id"""

_PASSAGES = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
s as (select *, case when count(*) over f = 20 then md5(string_agg(word, ' ') over f) end as h from p window f as (partition by doc_id order by i rows between current row and 19 following)),
r as (select *, h is not null and row_number() over (partition by h order by doc_id, i) > 1 as again from s),
c as (select *, coalesce(max(case when again then i end) over (partition by doc_id order by i rows between 19 preceding and current row), 0) > 0 as gone from r),
t as (select doc_id, count(*) filter (gone) as n_removed, sha256(coalesce(string_agg(word, ' ' order by i) filter (not gone), '')) as kept from c group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(t.n_removed, 0) as n_removed, coalesce(t.kept, sha256('')) as kept_sha256 from d left join t on t.doc_id = d.doc_id"""


_VALUE = "case when {0} is null then '-' else concat(cast(strlen(cast({0} as varchar)) as varchar), ':', cast({0} as varchar)) end"
_HASHED = "sha256(concat(" + ", ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + ", {}))"
_CRC_ODD = "list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end))"

_TREE = f"""
with recursive d as (select *, {_HASHED.format(_VALUE.format("text"))} as leaf, {_HASHED.format(_VALUE.format("replace(text, chr(10), '')"))} as cut, ({_CRC_ODD}) & 1 as odd from documents),
t as (select doc_id, leaf, case when odd = 1 then cut else leaf end as claim, row_number() over () as r, dense_rank() over (order by source nulls first) - 1 as gid,
  row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx from d),
nodes(gid, lvl, idx, h) as (select gid, 0, idx, leaf from t
  union all select gid, lvl + 1, idx // 3, sha256(string_agg(h, '' order by idx)) from (select *, count(*) over (partition by gid) as c from nodes) where c > 1 group by gid, lvl, idx // 3),
subroots as (select gid, h from (select *, row_number() over (partition by gid order by lvl desc) as last from nodes) where last = 1),
tops(lvl, idx, h) as (select 0, gid, h from subroots
  union all select lvl + 1, idx // 3, sha256(string_agg(h, '' order by idx)) from (select *, count(*) over () as c from tops) where c > 1 group by lvl, idx // 3),
roots as (select h from tops order by lvl desc limit 1),
every_node as (select gid, lvl, idx, h, count(*) over (partition by gid, lvl) as c, 0 as top from nodes union all select 0, lvl, idx, h, count(*) over (partition by lvl), 1 from tops),
beside as (select top, gid, lvl, idx, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as r
  from every_node where c > 1 window w as (partition by top, gid, lvl, idx // 3 order by idx)),
steps as (select t.r as row_no, b.l, b.r, row_number() over (partition by t.r order by b.top, b.lvl) as k
  from t join beside b on b.gid = case when b.top = 0 then t.gid else 0 end and b.idx = (case when b.top = 0 then t.idx else t.gid end) // cast(pow(3, b.lvl) as bigint)),
fold(row_no, k, h) as (select r, 0, claim from t union all select f.row_no, f.k + 1, sha256(concat(s.l, f.h, s.r)) from fold f join steps s on s.row_no = f.row_no and s.k = f.k + 1),
ends as (select row_no, h from (select *, row_number() over (partition by row_no order by k desc) as last from fold) where last = 1),
proofs as (select row_no, sha256(string_agg(concat(l, r), '' order by k)) as p from steps group by row_no)
select t.doc_id, t.leaf, s.h as subroot, roots.h as root, coalesce(p.p, sha256('')) as proof_sha256, e.h as folded_root, e.h = roots.h as verified
from t join subroots s on s.gid = t.gid join ends e on e.row_no = t.r left join proofs p on p.row_no = t.r, roots"""


def oracle_sql() -> dict[str, str]:
    """All pairs, all byte strings, all word windows, all hashes; the other operators are tested against brute force."""
    return {"op3_embeddings": _EMBEDDINGS, "op4_suffix_dedup": _BYTES, "op10_substring_dedup": _PASSAGES, "op11_merkle": _TREE}
