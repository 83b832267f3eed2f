"""voxlake: Spark operators for recordings, their segments, transcripts and workflows."""
