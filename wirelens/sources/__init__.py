"""Readers, frame decoders, schema helpers and sinks."""
