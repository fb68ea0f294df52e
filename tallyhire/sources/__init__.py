"""Tables in: schemas, readers and writers, and the portal views derived from the star schema."""
