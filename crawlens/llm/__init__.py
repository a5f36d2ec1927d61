"""Operations on training corpora: scans, deduplication, filters, mixing and tokenisation."""
