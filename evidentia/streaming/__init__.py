"""Call control over event streams, and streamed ingestion."""
