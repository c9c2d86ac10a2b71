"""Plan plumbing: cutting lineage in the shared folder, and driver-side loops."""
