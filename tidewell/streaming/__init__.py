"""Live bars: parsing, validation, upserts per batch, windows with watermarks and staleness."""
