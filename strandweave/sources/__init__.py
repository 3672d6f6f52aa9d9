"""Readers and writers: FASTQ, FASTA, tabular hits, delimited tables, reports."""
