"""What a crawled URL is: content types, extensions, classification of responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import path_only

# MIME types by kind, and the MIME type that a file extension promises.
GENERIC_MIMES = ["application/octet-stream", "binary/octet-stream", "application/binary", "application/unknown", "application/force-download", "application/download", "application/x-download", "text/plain", "unknown/unknown", "*/*"]
HTML_MIMES = ["text/html", "application/xhtml+xml", "application/xhtml", "text/xhtml", "application/vnd.wap.xhtml+xml"]
JS_MIMES = ["application/javascript", "text/javascript", "application/x-javascript", "application/ecmascript", "text/ecmascript", "application/node", "module"]
FONT_MIMES = ["application/font-woff", "application/font-woff2", "application/x-font-woff", "application/x-font-ttf", "application/x-font-truetype", "application/x-font-opentype", "application/x-font-otf", "application/font-sfnt", "application/vnd.ms-fontobject"]
EXTENSION_MIMES = {
    "html": "text/html",
    "htm": "text/html",
    "xhtml": "application/xhtml+xml",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "jpe": "image/jpeg",
    "jfif": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "avif": "image/avif",
    "svg": "image/svg+xml",
    "svgz": "image/svg+xml",
    "bmp": "image/bmp",
    "ico": "image/x-icon",
    "cur": "image/x-icon",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "heic": "image/heic",
    "heif": "image/heif",
    "apng": "image/apng",
    "css": "text/css",
    "js": "text/javascript",
    "mjs": "text/javascript",
    "cjs": "text/javascript",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "ttf": "font/ttf",
    "otf": "font/otf",
    "eot": "application/vnd.ms-fontobject",
    "pdf": "application/pdf",
    "zip": "application/zip",
    "rar": "application/vnd.rar",
    "gz": "application/gzip",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "csv": "text/csv",
    "json": "application/json",
    "xml": "application/xml",
    "txt": "text/plain",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "ogg": "audio/ogg",
    "mp4": "video/mp4",
    "webm": "video/webm",
    "mov": "video/quicktime",
    "avi": "video/x-msvideo",
}
ASSET_TYPES = ["IMAGE", "CSS", "JAVASCRIPT", "FONT", "PDF", "OTHER_ASSET"]
# Exception codes by type of error.
ERROR_CODES = {
    "TIMEOUT": ["UND_ERR_HEADERS_TIMEOUT", "UND_ERR_BODY_TIMEOUT", "UND_ERR_CONNECT_TIMEOUT"],
    "DNS_ERROR": ["ENOTFOUND", "EAI_AGAIN"],
    "TLS_ERROR": ["CERT_HAS_EXPIRED", "DEPTH_ZERO_SELF_SIGNED_CERT", "UNABLE_TO_VERIFY_LEAF_SIGNATURE"],
    "CONNECTION_ERROR": ["ECONNREFUSED", "ECONNRESET", "EHOSTUNREACH", "ENETUNREACH", "EPIPE"],
}


def normalize_content_type(header: Column) -> Column:
    mime = F.lower(F.trim(F.substring_index(header, ";", 1)))
    ok = mime.isin("module", "*/*") | mime.rlike(r"^[a-z0-9][a-z0-9!#$&^_.+-]*/[a-z0-9][a-z0-9!#$&^_.+-]*$")
    return F.when(ok, mime)


def is_generic_mime(mime: Column) -> Column:
    return mime.isNull() | mime.isin(GENERIC_MIMES)


def media_type_from_mime(mime: Column) -> Column:
    """Null for generic types."""
    return (
        F.when(is_generic_mime(mime), None)
        .when(mime.isin(HTML_MIMES), "HTML_PAGE")
        .when(mime.startswith("image/"), "IMAGE")
        .when(mime == "text/css", "CSS")
        .when(mime.isin(JS_MIMES), "JAVASCRIPT")
        .when(mime.startswith("font/") | mime.isin(FONT_MIMES), "FONT")
        .when(mime == "application/pdf", "PDF")
        .otherwise("OTHER_ASSET")
    )


def extension_of(url: Column) -> Column:
    absolute = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    path = F.when(absolute, path_only(url)).otherwise(F.substring_index(F.substring_index(url, "#", 1), "?", 1))
    found = F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]{1,8})$", 1))
    return F.when(found != "", found)


def mime_from_extension(url: Column) -> Column:
    pairs = [F.lit(x) for pair in EXTENSION_MIMES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), extension_of(url))


def media_type_from_extension(url: Column) -> Column:
    mime = mime_from_extension(url)
    return F.when(mime == "text/plain", "OTHER_ASSET").otherwise(media_type_from_mime(mime))


def classify(url: Column, final_url: Column, status: Column, content_type: Column, error_type: Column, redirects: Column) -> Column:
    """Struct of resource type, final type, media type, MIME and its source, mismatch, expectation, HTML flag, redirect flag.

    Errors come before the status, the status before the header, the header before the extension; on failure the extension
    says what was asked for, as the header then describes the error page.
    """
    return F.transform(F.array(F.struct(normalize_content_type(content_type).alias("mime"), mime_from_extension(F.coalesce(F.nullif(final_url, F.lit("")), url)).alias("final"), mime_from_extension(url).alias("own"))), lambda x: _classified(x["mime"], x["final"], x["own"], status, error_type, redirects))[0]


def _kind_of_extension(mime: Column) -> Column:
    return F.when(mime == "text/plain", "OTHER_ASSET").otherwise(media_type_from_mime(mime))


def _classified(mime: Column, final: Column, own: Column, status: Column, error_type: Column, redirects: Column) -> Column:
    """classify() from the MIME types of the header, the final URL's extension and the URL's own: each worked out once."""
    by_mime = media_type_from_mime(mime)
    by_extension = F.coalesce(_kind_of_extension(final), _kind_of_extension(own))
    hard = F.coalesce((error_type != "") & (error_type != "UNSUPPORTED_CONTENT"), F.lit(False))
    failed = hard | status.isNull() | (status >= 400)
    prefer = failed & by_extension.isNotNull()
    media = F.when(prefer, by_extension).otherwise(F.coalesce(by_mime, by_extension, F.lit("UNKNOWN")))
    source = F.when(prefer, "extension").when(by_mime.isNotNull(), "header").when(by_extension.isNotNull(), "extension").otherwise("none")
    expected = F.coalesce(final, own)
    mismatch = F.coalesce(~is_generic_mime(mime) & (expected != mime), F.lit(False))
    kind = F.when(failed, "ERROR").when(status >= 300, "REDIRECT").otherwise(media)
    redirected = F.coalesce(F.size(redirects) > 0, F.lit(False)) | F.coalesce(status.between(300, 399), F.lit(False))
    return F.struct(
        kind.alias("resource_type"), F.when(failed, "ERROR").otherwise(media).alias("final_resource_type"), media.alias("media_type"), mime.alias("mime_type"),
        source.alias("mime_source"), mismatch.alias("extension_mismatch"), expected.alias("expected_mime"), (kind == "HTML_PAGE").alias("is_html_document"), redirected.alias("redirected"),
    )


def is_html_page(resource_type: Column, content_type: Column | None = None) -> Column:
    """HTML_PAGE, or, of rows older than classification, an HTML content type (or none known)."""
    old = F.lit(True) if content_type is None else F.coalesce(normalize_content_type(content_type).isin(HTML_MIMES), F.lit(False))
    return F.when(resource_type.isNull(), old).otherwise(resource_type == "HTML_PAGE")


def is_asset(media_type: Column) -> Column:
    return F.coalesce(media_type.isin(ASSET_TYPES), F.lit(False))


def classify_error(name: Column, code: Column) -> Column:
    """Error type from an exception's name and code."""
    chain = F.when(name == "BlockedHostError", "BLOCKED_HOST").when(name == "AbortError", "TIMEOUT").when(code.startswith("ERR_TLS"), "TLS_ERROR")
    for kind, codes in ERROR_CODES.items():
        chain = chain.when(code.isin(codes), kind)
    return chain.otherwise("UNKNOWN")
