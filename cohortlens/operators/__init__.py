"""DataFrame operators: cleaning, first-seen dimensions, the skew-aware join, enrichment,
(author, month) cells, the three measures and series post-processing."""
