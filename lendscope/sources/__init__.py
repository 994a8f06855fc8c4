"""Sources and sinks: parquet/CSV scans, the loan_book view, result writers."""
