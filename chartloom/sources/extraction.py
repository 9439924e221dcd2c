"""Both sides of the offline extraction step: request lines out, responses in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.config import Limits
from chartloom.functions.text import data_url
from chartloom.operators.repair import repair_files
from chartloom.operators.staging import join_splittable

# Fixed values of the request and response format.
MAIN_OUTPUT_TOKENS = 40_000
REPAIR_OUTPUT_TOKENS = 5_000
FILE_NOTICE = "Arquivo seguinte: "
RESPONSE_SCHEMA = (
    "status STRING, output ARRAY<STRUCT<type STRING, content ARRAY<STRUCT<type STRING, text STRING, refusal STRING>>>>, "
    "error STRUCT<message STRING>"
)
PART = "struct<type:string,text:string,image_url:string,filename:string,file_data:string,detail:string>"


def _part(**members: Column) -> Column:
    names = ("type", "text", "image_url", "filename", "file_data", "detail")
    return F.struct(*[members.get(n, F.lit(None).cast("string")).alias(n) for n in names])


def request_parts(files: DataFrame) -> DataFrame:
    """Two content parts per file, in upload order: its label and its bytes as a data URL.  Row-local."""
    kind = F.col("content_type")
    url = data_url(kind, F.col("content"))
    label = _part(type=F.lit("input_text"), text=F.concat(F.lit(FILE_NOTICE), F.col("filename")))
    image = _part(type=F.lit("input_image"), image_url=url, detail=F.lit("high"))
    document = _part(
        type=F.lit("input_file"), filename=F.col("filename"), file_data=url,
        detail=F.when(kind == "application/pdf", F.lit("high")),
    )
    body = F.when(kind.startswith("image/"), image).otherwise(document)
    rest = [name for name in files.columns if name != "content"]
    return files.select(*rest, F.array(label, body).alias("parts"))


def request_lines(
    files: DataFrame, admitted: DataFrame, prompt: str, model: str,
    max_output_tokens: int = MAIN_OUTPUT_TOKENS, intake: str = "intake_no",
) -> DataFrame:
    """One JSON line per admitted intake.

    Only admitted sets are gathered, and admission bounds the bytes and the name
    lengths of a set, so no group can outgrow one request.
    """
    allowed = join_splittable(files, admitted.where("admitted").select(intake), [intake], "left_semi")
    gathered = request_parts(allowed).groupBy(intake).agg(
        F.array_sort(F.collect_list(F.struct("file_index", "parts"))).alias("_files")
    )
    content = F.concat(
        F.array(_part(type=F.lit("input_text"), text=F.lit(prompt))),
        F.flatten(F.transform("_files", lambda f: f["parts"])),
    )
    body = F.struct(
        F.lit(model).alias("model"), F.lit(False).alias("store"),
        F.lit(max_output_tokens).alias("max_output_tokens"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("input"),
        F.struct(F.struct(F.lit("json_object").alias("type")).alias("format")).alias("text"),
    )
    return gathered.select(intake, F.to_json(body).alias("line"))


def repair_lines(cases: DataFrame, files: DataFrame, prompt: str, model: str) -> DataFrame:
    """One request line (case_id, line) per incomplete case, over the files a second pass has to look at again.

    ``files`` (case_id, file_index, filename, content_type, content) are those of admitted sets, which bounds a line.
    """
    wanted = repair_files(cases, files)
    due = wanted.select("case_id").distinct().withColumn("admitted", F.lit(True))
    return request_lines(wanted, due, prompt, model, REPAIR_OUTPUT_TOKENS, "case_id")


def fold_responses(responses: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Classify raw responses (…, http_status, raw) and fold their text parts in order.

    A response over the size bound is ``too_large``, broken JSON ``invalid``.  The first refusal wins over any text.  Everything happens inside the row.
    """
    kept = [name for name in responses.columns if name not in ("raw", "http_status")]
    parsed = responses.select(
        *kept, "http_status", (F.octet_length("raw") > limits.max_response).alias("_large"),
        F.try_parse_json("raw").isNotNull().alias("_json"),
        F.from_json("raw", RESPONSE_SCHEMA).alias("_r"),
    )
    parts = F.flatten(F.transform(
        F.coalesce(F.col("_r.output"), F.array().cast("array<struct<type:string,content:array<struct<type:string,text:string,refusal:string>>>>")),
        lambda item: F.coalesce(item["content"], F.array().cast("array<struct<type:string,text:string,refusal:string>>")),
    ))
    staged = parsed.select("*", parts.alias("_parts"))
    refusal = F.get(F.transform(F.filter("_parts", lambda p: p["refusal"] != ""), lambda p: p["refusal"]), F.lit(0))
    text = F.array_join(
        F.transform(F.filter("_parts", lambda p: p["type"] == "output_text"), lambda p: p["text"]), ""
    )
    outcome = (
        F.when(F.col("_large"), "too_large")
        .when(~F.col("_json"), "invalid")
        .when(F.col("http_status") >= 300, "failed")
        .when(F.coalesce(F.col("_r.status") != "completed", F.lit(True)), "incomplete")
        .when(refusal.isNotNull(), "refused")
        .otherwise("ok")
    )
    judged = staged.select(*kept, outcome.alias("outcome"), "http_status", "_r", refusal.alias("_refusal"), text.alias("_text"))
    message = F.col("_r.error.message")
    return judged.select(
        *kept, "outcome",
        F.when(F.col("outcome") == "ok", F.col("_text")).alias("text"),
        F.when(F.col("outcome") == "refused", F.col("_refusal"))
        .when(F.col("outcome") == "failed", F.coalesce(F.when(message != "", message), F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))))
        .alias("detail"),
    )
