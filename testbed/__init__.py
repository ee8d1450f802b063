"""The library applied to the star-schema test tables, with SQL counterparts."""
