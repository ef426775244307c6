"""Source / sink round trips (S1-S9, S11, S13, S14): each job writes a derived table
to a scratch folder under the shared checkpoint folder and reads it back with an
explicit schema; the oracle is the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...fixtures import KEY, Tables, edit_seq, features, samples, vectors
from ...functions import text as TX
from ...functions import tokens as T
from ...operators import editseq as X
from ...oracle import with_fx
from ...registry import register
from ...sources import io, named_files
from .features import _TEXTS
from .text import c23_instruction_rows
from .relational import p5_level_rollup

K = 'sample_id, "index"'
SAMPLE_SCHEMA = "sample_id bigint, `index` bigint, role string, level bigint, ref_toks array<string>"


def _samples(spark, sf_dir):
    return samples(Tables(spark, sf_dir).conversations).select(*KEY, "role", "level", "ref_toks")


_S_SQL = with_fx("fx_samples", f"select {K}, role, level, ref_toks from fx_samples")


@register("s1_jsonl_roundtrip", _S_SQL)
def s1_jsonl_roundtrip(spark, sf_dir):
    path = io.scratch_path(spark, "s1")
    io.write_jsonl(_samples(spark, sf_dir), path)
    return io.read_jsonl(spark, path, SAMPLE_SCHEMA)


@register("s2_json_array_roundtrip", _S_SQL)
def s2_json_array_roundtrip(spark, sf_dir):
    path = io.scratch_path(spark, "s2")
    io.write_json_arrays(_samples(spark, sf_dir), path, KEY, rows_per_file=200)
    return io.read_json_array(spark, path, SAMPLE_SCHEMA)


@register("s3_csv_with_index", with_fx("fx_features", f"select {K}, NMT, NMS, sim_cocom from fx_features"))
def s3_csv_with_index(spark, sf_dir):
    f = features(Tables(spark, sf_dir).lineitem).select(*KEY, "NMT", "NMS", "sim_cocom")
    path = io.scratch_path(spark, "s3")
    # a pandas-style positional index column in front (header "Unnamed: 0" on re-read)
    io.write_csv(f.select(F.lit(0).alias("Unnamed: 0"), "*"), path)
    return io.read_csv(spark, path, "`Unnamed: 0` int, sample_id bigint, `index` bigint, NMT double, NMS double, "
                                    "sim_cocom double")


def _tolerant(spark, sf_dir):
    s = _samples(spark, sf_dir)
    text = F.when(F.col("sample_id") % 7 == 3, F.concat(F.lit("{broken "), F.col("role"))) \
        .otherwise(F.to_json(F.struct(*s.columns)))
    path = io.scratch_path(spark, "s4")
    s.select(text.alias("value")).write.mode("overwrite").text(path)
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(SAMPLE_SCHEMA)
    return io.read_jsonl_tolerant(spark, path, schema)


@register("s4_tolerant_scan", with_fx("fx_samples", f"select {K}, role, level, ref_toks from fx_samples "
                                                    "where sample_id % 7 <> 3"))
def s4_tolerant_scan(spark, sf_dir):
    good, _ = _tolerant(spark, sf_dir)
    return good


@register("s4_malformed_count", with_fx("fx_samples", "select count(*) as bad_lines from fx_samples "
                                                      "where sample_id % 7 = 3"))
def s4_malformed_count(spark, sf_dir):
    _, bad = _tolerant(spark, sf_dir)
    return bad.agg(F.count(F.lit(1)).alias("bad_lines"))


@register("s5_nested_jsonl_roundtrip", with_fx("fx_features", f"""select {K},
  struct_pack(NMT := NMT, NMS := NMS, CC_delta := CC_delta) as features, cast(refactoringTypeNum as int) as label
  from fx_features"""))
def s5_nested_jsonl_roundtrip(spark, sf_dir):
    f = features(Tables(spark, sf_dir).lineitem)
    rec = f.select(*KEY, F.struct("NMT", "NMS", "CC_delta").alias("features"),
                   F.col("refactoringTypeNum").cast("int").alias("label"))          # P12 nesting
    path = io.scratch_path(spark, "s5")
    io.write_jsonl(rec, path)
    return io.read_jsonl(spark, path, "sample_id bigint, `index` bigint, "
                                      "features struct<NMT:double,NMS:double,CC_delta:double>, label int")


_PRETTY = """'{' || chr(10) || '    "sample_id": ' || sample_id || ',' || chr(10) || '    "index": ' || "index" || ',' || chr(10)
  || '    "role": "' || role || '",' || chr(10) || '    "level": ' || level || ',' || chr(10) || '    "ref_toks": '
  || case when len(ref_toks) = 0 then '[]' else '[' || chr(10) || array_to_string(list_transform(ref_toks, lambda t: '        "' || t || '"'),
     ',' || chr(10)) || chr(10) || '    ]' end || chr(10) || '}'"""


@register("s6_pretty_json", with_fx("fx_samples", f"select {_PRETTY} as value from fx_samples"))
def s6_pretty_json(spark, sf_dir):
    return io.pretty_json_text(_samples(spark, sf_dir))


def _s7_sql():
    from ...oracle import with_fx as wf
    from .features import _TEXTS
    from .text import _CMT
    from ...functions.text import TRAIN_INSTRUCTION_CODE
    return wf("fx_edit_seq", f"""select {K}, '{TRAIN_INSTRUCTION_CODE}' as instruction,
  'old code: ' || src_method || chr(10) || 'new code: ' || dst_method || chr(10) || 'old comment: ' || src_desc
  || chr(10) || 'new comment: ' as input, dst_desc as output from tx join cm using (sample_id, "index")""",
              _TEXTS + ",\n" + _CMT)


@register("s7_instruction_export", _s7_sql())
def s7_instruction_export(spark, sf_dir):
    rows = c23_instruction_rows(spark, sf_dir)
    path = io.scratch_path(spark, "s7")
    io.write_jsonl(rows, path)
    return io.read_jsonl(spark, path, "sample_id bigint, `index` bigint, instruction string, input string, "
                                      "output string")


@register("s8_csv_sink", with_fx("fx_features", f"select {K}, CC_delta, delta_dependency from fx_features"))
def s8_csv_sink(spark, sf_dir):
    f = features(Tables(spark, sf_dir).lineitem).select(*KEY, "CC_delta", "delta_dependency")
    path = io.scratch_path(spark, "s8")
    io.write_csv(f, path)
    return io.read_csv(spark, path, "sample_id bigint, `index` bigint, CC_delta double, delta_dependency double")


_P5 = """select cast(coalesce(level, -1) as int) as level, count(*) as n, avg(len(ref_toks)) as avg_len
  from fx_samples group by grouping sets ((level), ())"""


@register("s9_append_log", with_fx("fx_samples", f"select * from ({_P5}) union all select * from ({_P5})"))
def s9_append_log(spark, sf_dir):
    rep = p5_level_rollup(spark, sf_dir)
    path = io.scratch_path(spark, "s9")
    io.append_log(rep, path)
    io.append_log(rep, path)
    return spark.read.schema("level int, n bigint, avg_len double").parquet(path)


@register("s10_named_files", with_fx("fx_edit_seq", f"""select 'cup_test_java_file/' || side || '_file' as folder, name, 'public class test{{' || chr(10) || method
  || chr(10) || '}}' as content from (
  select case when "index" <> 0 then sample_id || '_' || "index" else cast(sample_id as varchar) end || '.java' as name,
    'src' as side, src_method as method from tx union all
  select case when "index" <> 0 then sample_id || '_' || "index" else cast(sample_id as varchar) end || '.java', 'dst', dst_method from tx)""",
                                     _TEXTS))
def s10_named_files(spark, sf_dir):
    """A file for each method and side, named by its key, written and read back."""
    tx = X.method_texts(edit_seq(samples(Tables(spark, sf_dir).conversations)))
    name = F.concat(T.file_stem("sample_id", "index"), F.lit(".java"))
    sides = [tx.select(*KEY, F.lit(f"cup_test_java_file/{s}_file").alias("folder"), name.alias("name"),
                       TX.java_file_text(f"{s}_method").alias("content")) for s in ("src", "dst")]
    files, _ = named_files.last_of_name(sides[0].unionByName(sides[1]), KEY)
    path = io.scratch_path(spark, "s10_files")
    named_files.write_named_files(files, path)
    return named_files.read_named_files(spark, path)


@register("s11_index_roundtrip", with_fx("fx_vectors", """select vec_id, sample_id, "index", len(old_vec) as dim,
  cast(level as int) as level from fx_vectors where level = 1 and not is_query"""))
def s11_index_roundtrip(spark, sf_dir):
    v = vectors(Tables(spark, sf_dir).embeddings).where(~F.col("is_query"))
    path = io.scratch_path(spark, "s11")
    io.write_index(v.select("vec_id", "sample_id", "index", "old_vec", "new_vec", "level"), path)
    idx = io.load_index(spark, path, level=1)
    return idx.select("vec_id", "sample_id", "index", F.size("old_vec").cast("long").alias("dim"),
                      F.col("level").cast("int"))


@register("s13_aligned_text", with_fx("fx_samples", f"""select sample_id * 1000 + "index" as id,
  trim(array_to_string(src_toks, ' ')) as source, trim(array_to_string(ref_toks, ' ')) as reference,
  trim(array_to_string(hyp_toks, ' ')) as hypothesis from fx_samples"""))
def s13_aligned_text(spark, sf_dir):
    s = samples(Tables(spark, sf_dir).conversations).withColumn("id", F.col("sample_id") * 1000 + F.col("index"))
    parts = []
    for name, col in (("source", "src_toks"), ("reference", "ref_toks"), ("hypothesis", "hyp_toks")):
        path = io.scratch_path(spark, f"s13_{name}")
        io.write_aligned_text(s.withColumn("t", F.array_join(col, " ")), "id", "t", path)
        parts.append(io.read_aligned_text(spark, path, name))
    return parts[0].join(parts[1], "id").join(parts[2], "id")


@register("s14_null_output_log", with_fx("fx_samples", f"select 'm0' as model, {K} from fx_samples where sample_id % 5 = 0"))
def s14_null_output_log(spark, sf_dir):
    s = samples(Tables(spark, sf_dir).conversations)
    out = s.select(F.lit("m0").alias("model"), *KEY,
                   F.when(F.col("sample_id") % 5 == 0, F.lit(None).cast("string"))
                   .otherwise(F.array_join("hyp_toks", " ")).alias("new_comment"))
    path = io.scratch_path(spark, "s14")
    io.null_output_log(out, "new_comment", path, ["model", *KEY])
    return spark.read.schema("model string, sample_id bigint, `index` bigint").parquet(path)
