"""Names, dates and digests as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ARCHIVE, IMAGES, VIDEO


def slug(name: Column) -> Column:
    """Lower case, only a-z and 0-9, at most 15 characters."""
    return F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), 1, 15)


def job_id(company: Column, campaign: Column, at: Column) -> Column:
    return F.concat(slug(company), F.lit("_"), slug(campaign), F.lit("_"), F.date_format(at, "yyyyMMddHHmmss"))


def suffix(name: Column) -> Column:
    """The last .ext with the dot, lower case; empty for names that only begin or end with a dot."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def url_suffix(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"[^/](\.[^./?#]+)$", 1))


def file_type(ext: Column) -> Column:
    """video, zip or image; null for what isn't allowed."""
    return F.when(ext.isin(*VIDEO), "video").when(ext == ARCHIVE, "zip").when(ext.isin(*IMAGES), "image")


def sanitized(name: Column) -> Column:
    """Without spaces and dots at both ends and control characters; characters that file systems refuse become _."""
    return F.regexp_replace(F.translate(F.btrim(name, F.lit(" .")), '<>:"|?*', "_" * 7), r"[\x00-\x1F]", "")


def campaign_date(value: Column) -> Column:
    """A date from year-month-day with one or two digits for month and day; null for anything else."""
    return F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(value, "y-M-d"))


def frame_name(number: Column) -> Column:
    return F.format_string("frame_%06d.jpg", number)


def qualified(path: Column, root: Column) -> Column:
    """The name of a file below a folder: its path there, with _ between the parts, and six digits where the first part is a number."""
    below = F.substring(path, F.length(root) + 2, F.length(path))
    first, rest = F.split_part(below, F.lit("/"), F.lit(1)), F.regexp_replace(below, "^[^/]*/", "")
    return F.when(below.rlike("^[0-9]+/"), F.concat(F.lpad(first, 6, "0"), F.lit("_"), F.translate(rest, "/", "_"))).otherwise(F.translate(below, "/", "_"))


def digest(secret: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), secret), 256)


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_short(at: Column) -> Column:
    """ISO text, with the fraction of the second only where there is one."""
    return F.regexp_replace(iso(at), r"\.000000$", "")


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def western_digits(value: Column) -> Column:
    return F.translate(value, "۰۱۲۳۴۵۶۷۸۹", "0123456789")


def base64(content: Column) -> Column:
    """Base 64 without line breaks, whatever the session's setting."""
    return F.translate(F.base64(content), "\r\n", "")


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), base64(content))


def caption(index: Column, name: Column) -> Column:
    """What stands before a frame's picture in a request."""
    return F.concat(F.lit("\nFrame "), index.cast("string"), F.lit(": "), name)


def minute(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def share(part: Column, whole: Column) -> Column:
    """part/whole, and - where the whole is missing or 0."""
    return F.when(whole > 0, F.concat_ws("/", F.coalesce(part, F.lit(0)).cast("string"), whole.cast("string"))).otherwise("-")


def whole(value: Column) -> Column:
    """A number as it is shown: without its fraction."""
    return value.cast("int")


def badge(status: Column) -> Column:
    """The colour class of a status."""
    return F.when(status == "completed", "success").when(status == "failed", "danger").when(status == "processing", "warning").otherwise("secondary")
