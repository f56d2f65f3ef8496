"""Requests: validation, source and caption URLs, metadata, and catalog records in two JSON shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framequarry.functions.scalars import after_comma, first_present, merged_maps, present

ASSET = "struct<url:string,type:string,mimeType:string>"
LISTING = f"struct<broadcast_id:string,shop_id:string,broadcast_title:string,hls_url:string,closed_captions:string,aci_content_id:string,reference_id:string,synopsis:string,formatted_duration:string,video_preview_assets:array<{ASSET}>>"
REQUEST = f"request_id string, video_url string, transcript_url string, bucket string, main_folder string, account_id string, content_id string, video_key string, transcript_key string, metadata map<string,string>, custom_metadata map<string,string>, listing {LISTING}"

REQUIRED = ["bucket", "main_folder", "account_id", "content_id", "video_key"]

#: Listing fields that join a request's metadata, in order.
LISTING_METADATA = ["broadcast_id", "shop_id", "broadcast_title", "aci_content_id", "reference_id", "synopsis", "formatted_duration"]


def parse_requests(raw: DataFrame, column: str = "value", listing_key: str = "listing") -> DataFrame:
    """JSON texts to requests. Malformed ones keep their text in `malformed` and have nulls; listing_key: the name
    under which callers send the listing."""
    renamed = REQUEST.replace("listing struct", f"`{listing_key}` struct")
    parsed = raw.select(F.col(column).alias("raw"), F.from_json(column, renamed + ", malformed string", {"columnNameOfCorruptRecord": "malformed"}).alias("r")).select("raw", "r.*")
    return parsed.withColumnRenamed(listing_key, "listing").withColumn("malformed", F.when(F.col("malformed").isNotNull(), F.col("raw"))).drop("raw")


def missing_parameters(rows: DataFrame, required: list[str] = REQUIRED, empty_is_missing: bool = True) -> DataFrame:
    """Adds error: the parameters that are missing, in order; null where all are there."""
    gone = F.filter(F.array(*(F.when((present(F.col(c)) if empty_is_missing else F.col(c)).isNull(), F.lit(c)) for c in required)), lambda x: x.isNotNull())
    return rows.withColumn("error", F.when(F.size(gone) > 0, F.concat(F.lit("missing: "), F.array_join(gone, ", "))))


def best_asset(assets: Column) -> Column:
    """URL of the longest-named MP4 asset, else of any; of equals the first. Null without assets."""

    def longest(found: Column) -> Column:
        keyed = F.transform(found, lambda a, i: F.struct((-F.length(F.coalesce(a["url"], F.lit("")))).alias("n"), i.alias("i"), a["url"].alias("url")))
        return F.get(F.array_sort(keyed), F.lit(0))["url"]

    mp4 = F.filter(assets, lambda a: a["mimeType"] == "video/mp4")
    return F.when(F.size(mp4) > 0, longest(mp4)).when(F.size(assets) > 0, longest(assets))


def constructed_url(base: str | None, broadcast_id: Column) -> Column:
    """The last resort: a URL from a configured base and the broadcast's id."""
    if not base:
        return F.lit(None).cast("string")
    return F.when(present(broadcast_id).isNotNull(), F.concat(F.lit(base.rstrip("/") + "/"), broadcast_id, F.lit("/default.mp4")))


def resolved(rows: DataFrame, fallback_base: str | None = None) -> DataFrame:
    """Adds source_url, caption_url and merged metadata; error where there is no source.

    A listing's stream goes before its assets, those before a constructed URL; requests without a listing use their own
    URLs. A listing's values replace those of the same keys in the request's metadata.
    """
    listing = F.col("listing")
    from_listing = first_present(listing["hls_url"], best_asset(listing["video_preview_assets"]), constructed_url(fallback_base, listing["broadcast_id"]))
    pairs = F.map_from_arrays(F.array(*(F.lit(c) for c in LISTING_METADATA)), F.array(*(listing[c] for c in LISTING_METADATA)))
    rows = rows.withColumns({
        "source_url": F.when(listing.isNotNull(), from_listing).otherwise(present(F.col("video_url"))),
        "caption_url": F.when(listing.isNotNull(), after_comma(present(listing["closed_captions"]))).otherwise(present(F.col("transcript_url"))),
        "metadata": F.when(listing.isNotNull(), merged_maps(F.col("metadata"), pairs)).otherwise(F.coalesce("metadata", F.create_map().cast("map<string,string>"))),
    })
    return rows.withColumn("error", F.when(F.col("source_url").isNull(), F.lit("no video URL")))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to work on, rows that end with an error)."""
    return rows.where("error is null"), rows.where("error is not null")


ASSETS = f"array<{ASSET}>"
AGGREGATED = f"struct<id:string,aciContentId:string,title:string,synopsis:string,referenceId:string,formattedDuration:string,hlsUrl:string,closedCaptions:string,creationDate:string,creatorType:string,channelTitle:string,relatedProductsAsins:array<string>,imageResource:struct<physicalId:string,extension:string,width:int,height:int>,videoPreviewAssets:{ASSETS}>"
DETAIL = f"struct<contentId:string,aciContentId:string,title:string,synopsis:string,referenceId:string,formattedDuration:string,url:string,closedCaptions:string,creationDate:string,creator:struct<publicName:string,creatorType:string>,relatedProductsAsins:string,width:int,height:int,videoPreviewAssets:{ASSETS}>"


def catalog_assets(records: DataFrame, column: str = "value") -> DataFrame:
    """Catalog records of either JSON shape as one row each: an aggregated record has `hlsUrl` and a list of products,
    a detail record `contentId` and one product as text."""
    a, d = F.from_json(column, AGGREGATED), F.from_json(column, DETAIL)
    detail = F.get_json_object(column, "$.contentId").isNotNull()
    products = F.when(detail, F.when(present(d["relatedProductsAsins"]).isNotNull(), F.split(d["relatedProductsAsins"], r"\s*,\s*"))).otherwise(a["relatedProductsAsins"])
    return records.select(
        F.when(detail, d["contentId"]).otherwise(a["id"]).alias("content_id"),
        F.when(detail, "detail").otherwise("aggregated").alias("shape"),
        F.when(detail, d["aciContentId"]).otherwise(a["aciContentId"]).alias("aci_content_id"),
        F.when(detail, d["title"]).otherwise(a["title"]).alias("title"),
        F.when(detail, d["synopsis"]).otherwise(a["synopsis"]).alias("synopsis"),
        F.when(detail, d["referenceId"]).otherwise(a["referenceId"]).alias("reference_id"),
        F.when(detail, d["formattedDuration"]).otherwise(a["formattedDuration"]).alias("formatted_duration"),
        first_present(F.when(detail, d["url"]), a["hlsUrl"]).alias("stream_url"),
        F.when(detail, d["closedCaptions"]).otherwise(a["closedCaptions"]).alias("closed_captions"),
        F.when(detail, d["creator"]["creatorType"]).otherwise(a["creatorType"]).alias("creator_type"),
        F.when(detail, d["creator"]["publicName"]).otherwise(a["channelTitle"]).alias("creator"),
        F.to_timestamp(F.when(detail, d["creationDate"]).otherwise(a["creationDate"])).alias("created"),
        products.alias("products"),
        F.when(detail, d["videoPreviewAssets"]).otherwise(a["videoPreviewAssets"]).alias("assets"),
    )


def variants_of(records: DataFrame, column: str = "value") -> DataFrame:
    """records with v, the JSON text as a VARIANT, and error where it is malformed; a null text has neither."""
    v = F.try_parse_json(column)
    return records.withColumn("v", v).withColumn("error", F.when(v.isNull() & F.col(column).isNotNull(), F.concat(F.lit("malformed JSON: "), F.left(F.col(column), F.lit(500)))))


def variant_fields(records: DataFrame, key: list[str], column: str = "value") -> DataFrame:
    """(key columns, field, kind, text, error): the top-level fields of every record, whatever its shape, with the type
    that each has there; one row with an error for a malformed text."""
    rows = variants_of(records, column)
    good = rows.where("v is not null").select(*key, F.col("v"))
    fields = good.lateralJoin(good.sparkSession.tvf.variant_explode(F.col("v").outer()))
    told = fields.select(*key, F.col("key").alias("field"), F.schema_of_variant("value").alias("kind"), F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value")).alias("text"), F.lit(None).cast("string").alias("error"))
    bad = rows.where("error is not null").select(*key, *(F.lit(None).cast("string").alias(c) for c in ("field", "kind", "text")), "error")
    return told.unionByName(bad)


def inferred_schema(records: DataFrame, column: str = "value") -> DataFrame:
    """One row: schema, of all records that are JSON, merged by an aggregate, and how many texts are malformed."""
    rows = variants_of(records, column)
    return rows.agg(F.schema_of_variant_agg("v").alias("schema"), F.count("error").alias("malformed"))


def variant_assets(records: DataFrame, column: str = "value") -> DataFrame:
    """Catalog records of either shape, or of one not met before, as one row each, read field by field from a VARIANT: a
    field may be absent, and products may be a list or a text. Malformed texts are error rows."""
    rows = variants_of(records, column)
    text = lambda *paths: F.coalesce(*(F.try_variant_get("v", f"$.{p}", "string") for p in paths))
    listed = F.try_variant_get("v", "$.relatedProductsAsins", "array<string>")
    products = F.coalesce(listed, F.split(present(text("relatedProductsAsins")), r"\s*,\s*"))
    detail = text("contentId").isNotNull()
    return rows.select(
        text("contentId", "id").alias("content_id"),
        F.when(F.col("v").isNotNull(), F.when(detail, "detail").otherwise("aggregated")).alias("shape"),
        text("title").alias("title"),
        first_present(text("url"), text("hlsUrl")).alias("stream_url"),
        text("creator.publicName", "channelTitle").alias("creator"),
        products.alias("products"),
        F.try_variant_get("v", "$.videoPreviewAssets", ASSETS).alias("assets"),
        "error",
    )
