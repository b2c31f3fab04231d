"""Tables in and out of the engine, and bindings of the test tables."""
