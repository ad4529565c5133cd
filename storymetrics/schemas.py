"""Schemas and fixed values of the campaign-metrics model."""

from pyspark.sql import types as T

#: The metric names in the order of the model, and the columns of the export with their headings and widths.
METRIC_NAMES = (
    "views", "followers", "non_followers", "accounts_reached", "interactions", "likes", "replies", "shares", "links_clicks", "sticker_taps",
    "navigation", "forward", "next_story", "back", "exited", "profile_activity", "profile_visits", "external_link_taps", "follows",
)
EXPORT = (
    ("id", "Job ID", 36), ("campaign_date", "Campaign Date", 12), ("campaign_name", "Campaign Name", 20), ("product_name", "Product Name", 20), ("company", "Company", 20),
    ("filename", "Filename", 25), ("file_type", "File Type", 10), ("status", "Status", 12), ("created_at", "Created At", 20), ("completed_at", "Completed At", 20),
    ("total_frames", "Total Frames", 12), ("good_frames", "Good Frames", 12), ("bad_frames", "Bad Frames", 12), ("processing_time_seconds", "Processing Time (s)", 15),
    ("views", "Views (Max)", 14), ("accounts_reached", "Accounts Reached (Max)", 14), ("followers", "Followers (Max)", 14), ("non_followers", "Non-Followers (Max)", 14),
    ("interactions", "Interactions (Max)", 14), ("likes", "Likes (Max)", 14), ("replies", "Replies (Max)", 14), ("shares", "Shares (Max)", 14),
    ("profile_visits", "Profile Visits (Max)", 14), ("follows", "Follows (Max)", 14), ("links_clicks", "Links Clicks (Max)", 14), ("sticker_taps", "Sticker Taps (Max)", 14),
    ("navigation", "Navigation (Max)", 14), ("forward", "Forward (Max)", 14), ("next_story", "Next Story (Max)", 14), ("back", "Back (Max)", 14),
    ("exited", "Exited (Max)", 14), ("profile_activity", "Profile Activity (Max)", 14), ("external_link_taps", "External Link Taps (Max)", 14),
)
FRACTIONS = ("followers", "non_followers")
VIDEO, IMAGES, ARCHIVE = (".mp4", ".avi", ".mov", ".mkv"), (".jpg", ".jpeg", ".png"), ".zip"
TERMINAL = ("completed", "failed")

JOBS = "id string, campaign_date date, campaign_name string, product_name string, company string, filename string, file_type string, status string, created_at timestamp_ntz, completed_at timestamp_ntz, error_message string, warnings array<string>, path string"
JOB_METRICS = "job_id string, total_frames int, good_frames int, bad_frames int, processing_time_seconds int, metrics_json string, created_at timestamp_ntz"
USERS = "id bigint, username string, password_hash string, created_at timestamp_ntz"
METRICS = T.StructType([T.StructField(n, T.DoubleType() if n in FRACTIONS else T.LongType()) for n in METRIC_NAMES])
METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("language", "date_range", "content_type")])
QUARANTINE = "job_id string, batch_id bigint, pos int, raw string, created_at timestamp_ntz"
ATTEMPTS = "job_id string, batch_id bigint, attempt int, outcome string, wait int, slept double, status int, created_at timestamp_ntz"
SUMMARY = "map<string,struct<max:variant,min:variant,avg:double,last:variant>>"
REJECTED = "filename string, campaign_date string, campaign_name string, product_name string, company string, submitted_at timestamp_ntz, reason string"
