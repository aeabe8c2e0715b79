"""Training-data operators: scoring, tokenising, extraction, quality, de-duplication, search, mixing and scans."""
