"""Part of arborseq."""
