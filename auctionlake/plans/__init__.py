"""Jobs, and the catalog of registered queries with their reference SQL."""
