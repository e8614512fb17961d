"""Sources and sinks: WARC files, crawls, delimited text, transcripts."""
