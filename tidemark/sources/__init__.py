"""Reading and writing: the catalogue adapter, file sources and sinks."""
