"""Sources and sinks: arrays, frames, sparse matrices and text files."""
