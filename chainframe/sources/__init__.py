"""Sources, sinks and table lifecycle: schemas, fixture derivations, ingest, layout."""
