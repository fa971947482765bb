"""Which tables are built from which, and the job that builds and exports them all."""
