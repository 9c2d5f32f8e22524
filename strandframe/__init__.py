"""DataFrames for sequencing alignments and training corpora."""
