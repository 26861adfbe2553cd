"""Runs as a stream: results that arrive as files go to the runs table once each."""
