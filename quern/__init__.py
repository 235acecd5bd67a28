"""User-level data jobs for Spark: tables, calendars, points on a map, measurement runs, models."""
