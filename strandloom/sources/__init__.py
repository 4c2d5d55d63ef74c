"""Sources and sinks: FASTQ text, packed k-mer files, printed text."""
