"""Progress of processing runs, from a finished log and as a stream."""
