"""Where streams come from and go to: schemas, decoders, sources, encoders, sinks."""
