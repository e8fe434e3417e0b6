"""File scans and Parquet-backed state."""
