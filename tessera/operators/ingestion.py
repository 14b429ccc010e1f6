"""Schema discovery and the generic transform of rows to documents.

The catalog of a source is small frames (tables, columns, relationships). From it one wide select is
generated for each table, so a row becomes a document without a Python function and in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import nested, strings
from tessera.sources import tables as src

DOCUMENT = (
    "doc_id string, source_table string, source_id string, project_id bigint, metadata map<string,string>, "
    "relationships array<struct<target_doc_id:string,target_table:string,target_id:string,source_column:string,relationship_type:string,direction:string,cardinality:string>>, "
    "file_references array<struct<s3_key:string,source_column:string,reference_type:string,filename:string,file_id:string,url:string>>, "
    "content_text string, created_at bigint, updated_at bigint, ingested_at bigint"
)
#: Fields that make a record's text, by table; others take the common ones they have.
COMMON_TEXT = ("name", "title", "description", "number")
TEXT_FIELDS: dict[str, tuple[str, ...]] = {
    "projects": ("name", "display_name", "address", "city", "project_number"),
    "photos": ("description", "location"),
    "drawings": ("drawing_number", "title", "discipline"),
    "drawing_revisions": ("revision_number", "filename"),
    "drawing_areas": ("name",),
    "drawing_sets": ("name",),
    "rfis": ("number", "subject", "question"),
    "submittals": ("number", "title", "description"),
    "submittal_attachments": ("filename", "content_type"),
    "change_orders": ("number", "title", "description"),
    "change_events": ("title", "description", "status", "event_type", "change_reason"),
    "commitment_contracts": ("number", "title", "description", "status"),
    "commitment_contract_items": ("description", "uom"),
    "commitment_change_orders": ("number", "title", "description", "status"),
    "commitment_change_order_items": ("description", "uom"),
    "prime_contracts": ("number", "title", "description", "status"),
    "prime_contract_change_orders": ("number", "title", "description", "status"),
    "prime_contract_line_items": ("description",),
    "owner_invoices": ("invoice_number", "status"),
    "vendors": ("name", "abbreviated_name", "trade_name"),
    "company_users": ("name", "job_title", "email_address"),
    "project_users": (),
    "project_roles": ("role_name", "user_name"),
    "budget_line_items": ("description", "cost_code_name", "root_cost_code_name"),
    "budget_views": ("name", "view_type"),
    "direct_costs": ("description", "invoice_number", "direct_cost_type"),
    "direct_cost_items": ("description", "uom", "ref"),
    "requisitions": ("invoice_number", "status", "vendor_name", "comment"),
    "invoice_submissions": ("invoice_number", "status"),
    "specification_sections": ("number", "label", "description"),
    "specification_section_divisions": ("number", "description"),
    "specification_section_revisions": ("number", "description", "revision", "filename"),
    "daily_logs": ("log_type", "description"),
    "timesheets": ("name", "number", "status"),
    "vendor_insurances": ("name", "insurance_type", "policy_number", "status"),
    "documents": ("name", "file_type"),
}
_REFERENCE = "struct<s3_key:string,source_column:string,reference_type:string,filename:string,file_id:string,url:string>"
_LINK = "struct<target_doc_id:string,target_table:string,target_id:string,source_column:string,relationship_type:string,direction:string,cardinality:string>"


def infer_relationships(columns: DataFrame, tables: DataFrame, suffix: str = "_id") -> DataFrame:
    """(source_table, source_column, target_table): foreign keys told by name. A column ``x_id`` refers to the first of
    the table of x with an s, of x in the plural, or, where neither y nor s ends it, of x itself, that exists. Catalogs are broadcast:
    they have a row a table."""
    keys = columns.where((F.col("column_name") != "id") & F.col("column_name").endswith(suffix))
    base = F.regexp_replace("column_name", f"{suffix}$", "")
    tries = F.when(base.endswith("y"), F.array(F.concat(base, F.lit("s")), strings.plural(base))).otherwise(
        F.when(base.endswith("s"), F.array(F.concat(base, F.lit("s")), strings.plural(base))).otherwise(F.array(F.concat(base, F.lit("s")), base))
    )
    asked = keys.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), F.posexplode(tries).alias("turn", "target_table"))
    found = asked.join(F.broadcast(tables.select(F.col("table_name").alias("target_table"))), "target_table")
    return found.groupBy("source_table", "source_column").agg(F.min_by("target_table", "turn").alias("target_table"))


def file_columns(columns: DataFrame) -> DataFrame:
    """(table_name, column_name, kind) of the columns that refer to files."""
    return columns.withColumn("kind", strings.column_kind(F.col("column_name"), F.col("data_type"))).where("kind is not null").select("table_name", "column_name", "kind")


def incoming_hints(relationships: DataFrame) -> DataFrame:
    """(target_table, source_table, source_column, relationship_type, cardinality, query_hint)."""
    hint = F.concat(F.lit("Find "), F.col("source_table"), F.lit(" where "), F.col("source_column"), F.lit(" = id"))
    return relationships.select("target_table", "source_table", "source_column", strings.incoming_type(F.col("source_table")).alias("relationship_type"), F.lit("one_to_many").alias("cardinality"), hint.alias("query_hint"))


def links(df: DataFrame, relationships: dict[str, str]) -> Column:
    """The outgoing links of a row: a struct for each foreign key that isn't null; the target need not exist."""
    made = [
        F.when(
            F.col(c).isNotNull(),
            F.struct(
                F.concat(F.lit(f"{t}:"), F.col(c).cast("string")).alias("target_doc_id"), F.lit(t).alias("target_table"), F.col(c).cast("string").alias("target_id"), F.lit(c).alias("source_column"),
                strings.outgoing_type(F.lit(c)).alias("relationship_type"), F.lit("outgoing").alias("direction"), F.lit("many_to_one").alias("cardinality"),
            ),
        )
        for c, t in sorted(relationships.items())
    ]
    return F.array_compact(F.array(*made)) if made else F.array().cast(f"array<{_LINK}>")


def file_references(df: DataFrame, kinds: dict[str, str]) -> Column:
    """The file references of a row, by the kind of each column; empty ones are left out."""
    none = F.lit(None).cast("string")

    def made(key: Column, column: str, kind: str, name: Column, file_id: Column, url: Column) -> Column:
        return F.struct(key.alias("s3_key"), F.lit(column).alias("source_column"), F.lit(kind).alias("reference_type"), name.alias("filename"), file_id.alias("file_id"), url.alias("url"))

    def of_map(column: str, kind: str):
        return lambda e: made(e["value"], column, kind, strings.basename(e["value"]), e["key"], none)

    parts = []
    for c, kind in sorted(kinds.items()):
        v = F.col(c).cast("string")
        if kind == "jsonb_s3_map":
            parts.append(F.transform(nested.key_map(v), of_map(c, kind)))
        elif kind == "url":
            parts.append(F.array_compact(F.array(F.when(v != "", made(F.lit(""), c, kind, none, none, v)))))
        else:
            parts.append(F.array_compact(F.array(F.when(v != "", made(v, c, kind, strings.basename(v), none, none)))))
    return F.flatten(F.array(*parts)) if parts else F.array().cast(f"array<{_REFERENCE}>")


def to_documents(df: DataFrame, table: str, relationships: dict[str, str], kinds: dict[str, str], now: int, key: str = "id", text_fields: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): every row with a key, and a project id that is null or a number, as a document; the
    others with the reason.

    Numbers among timestamps are seconds; a missing or zero time is ``now``.
    """
    project = F.col("project_id").try_cast("long") if "project_id" in df.columns else F.lit(None).cast("long")
    no_number = F.col("project_id").isNotNull() & project.isNull() if "project_id" in df.columns else F.lit(False)
    error = F.when(F.col(key).isNull(), F.lit(f"Row without {key}")).when(no_number, F.lit("project_id is not a number"))
    ok, bad = df.where(error.isNull()), df.where(error.isNotNull())
    wanted = text_fields if text_fields is not None else TEXT_FIELDS.get(table, COMMON_TEXT)
    text = [c for c in wanted if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    time = {c: nested.epoch_millis(df, c) if c in df.columns else F.lit(None).cast("long") for c in ("created_at", "updated_at")}
    ident = F.col(key).cast("string")
    documents = ok.select(
        F.concat(F.lit(f"{table}:"), ident).alias("doc_id"), F.lit(table).alias("source_table"), ident.alias("source_id"), project.alias("project_id"),
        nested.row_map(df, [c for c in df.columns]).alias("metadata"), links(df, relationships).alias("relationships"), file_references(df, kinds).alias("file_references"),
        strings.content_text([F.col(c) for c in text]).alias("content_text") if text else F.lit("").alias("content_text"),
        nested.or_now(time["created_at"], now).alias("created_at"), nested.or_now(time["updated_at"], now).alias("updated_at"), F.lit(now).cast("long").alias("ingested_at"),
    )
    rejects = bad.select(F.lit(table).alias("source_table"), error.alias("error"))
    return documents, rejects


def detected_files(documents: DataFrame) -> DataFrame:
    """(doc_id, source_table, s3_key, url, filename, extension, file_id, key): a row a reference; URLs
    without scheme and host are left out; the key is the storage key, else the URL."""
    f = documents.select("doc_id", "source_table", F.explode("file_references").alias("f")).select("doc_id", "source_table", "f.*")
    f = f.withColumn("s3_key", F.nullif(F.trim("s3_key"), F.lit(""))).withColumn("url", F.nullif(F.trim("url"), F.lit("")))
    ok = F.col("s3_key").isNotNull() | strings.url_parts(F.col("url"))[0].isNotNull()
    name = F.coalesce("filename", strings.url_parts(F.col("url"))[2])
    return f.where(ok).select("doc_id", "source_table", "s3_key", "url", name.alias("filename"), strings.extension(name).alias("extension"), "file_id", F.coalesce("s3_key", "url").alias("key"))


def provenance(table: Column, record: Column, column: Column) -> tuple[Column, Column]:
    """(tags, description) of a file's pages."""
    return F.array(table, F.concat(F.lit("record:"), record), F.concat(F.lit("column:"), column)), F.concat(F.lit("Source: "), table, F.lit(" (record "), record, F.lit(")"))


def metadata_documents(columns: DataFrame, relationships: DataFrame, counts: DataFrame, database: str) -> DataFrame:
    """One document a table and one for the schema, with names, descriptions, columns and relationships."""
    cols = columns.groupBy("table_name").agg(F.array_sort(F.collect_list("column_name")).alias("columns"))
    out = relationships.groupBy(F.col("source_table").alias("table_name")).agg(F.count("*").alias("n_out"))
    into = relationships.groupBy(F.col("target_table").alias("table_name")).agg(F.count("*").alias("n_in"))
    one = cols.join(out, "table_name", "left").join(into, "table_name", "left").join(counts, "table_name", "left")
    one = one.select(F.concat(F.lit("table:"), "table_name").alias("doc_id"), F.concat_ws(" ", "table_name", F.array_join("columns", " ")).alias("content_text"), F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))
    whole = one.agg(F.sum("row_count").alias("row_count"), F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"), F.count("*").alias("n"))
    whole = whole.select(F.lit(f"schema:{database}").alias("doc_id"), F.concat(F.lit(f"{database} with "), "n", F.lit(" tables")).alias("content_text"), "row_count", "n_out", "n_in")
    return one.unionByName(whole)


def schema_report(columns: DataFrame, counts: DataFrame) -> str:
    """The schema in Markdown, the largest tables first; catalogs have a row a column, and are read whole."""
    out = ["# Schema", ""]
    by: dict[str, list] = {}
    for r in columns.orderBy("table_name", "position").toLocalIterator():
        by.setdefault(r["table_name"], []).append(r)
    sizes = {r["table_name"]: r["row_count"] for r in counts.toLocalIterator()}
    for name in sorted(by, key=lambda t: (-sizes.get(t, 0), t)):
        out += [f"## {name} ({sizes.get(name, 0):,} rows)", "", "| column | type | nullable | default |", "|---|---|---|---|"]
        for r in by[name]:
            default = r["column_default"] or "" if "column_default" in r else ""
            out.append(f"| {r['column_name']} | {r['data_type']} | {'yes' if r['nullable'] else 'no'} | {default[:27] + '...' if len(default) > 30 else default} |")
        out.append("")
    return "\n".join(out)


def discover(spark: SparkSession, frames: dict[str, DataFrame], suffix: str = "_id") -> dict[str, DataFrame]:
    """tables, columns, relationships, files and counts of named frames, as small frames."""
    tables, columns = src.catalog(frames)
    t = spark.createDataFrame(tables, "table_name string")
    c = spark.createDataFrame(columns, "table_name string, column_name string, data_type string, nullable boolean, position int")
    return {"tables": t, "columns": c, "relationships": infer_relationships(c, t, suffix), "files": file_columns(c), "counts": src.row_counts(frames)}


def verified(relationships: DataFrame, frames: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """``relationships`` held against the rows: (source_table, source_column, target_table, rows, orphans, most), how many rows have a key,
    how many of these name no row of the target, and how many name the same one at most.

    Keys are counted where they are read, so a key that a third of all rows have is a row a task in the joins. Relationships are a row
    a foreign key; their plans are united, and targets without a column ``key`` are left out.
    """
    out = None
    for r in relationships.orderBy("source_table", "source_column").collect():
        target = frames[r["target_table"]]
        if key not in target.columns:
            continue
        held = frames[r["source_table"]].groupBy(F.col(r["source_column"]).alias("k")).agg(F.count("*").alias("n")).where("k IS NOT NULL")
        known = held.join(target.select(F.col(key).alias("k")).distinct().withColumn("known", F.lit(True)), "k", "left")
        found = known.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("orphans"), F.max(F.when(F.col("known"), F.col("n"))).alias("most"))
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "orphans", "most")]
        one = found.select(*[F.lit(r[c]).alias(c) for c in ("source_table", "source_column", "target_table")], *zero)
        out = one if out is None else out.unionByName(one)
    kinds = "source_table string, source_column string, target_table string, rows long, orphans long, most long"
    return out if out is not None else relationships.sparkSession.createDataFrame([], kinds)


def union_documents(parts: list[DataFrame]) -> DataFrame:
    """All tables' documents in one frame."""
    return reduce(DataFrame.unionByName, parts)
