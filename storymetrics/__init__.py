"""A campaign-metrics engine on Spark: intake, frames, quality, replies, summaries, store and reports."""
