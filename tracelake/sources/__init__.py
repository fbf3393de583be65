"""Sources: the log, line files with byte offsets, framed files, provider transcripts."""
