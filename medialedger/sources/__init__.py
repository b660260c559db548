"""Reading and writing: listings, images, catalogs, tags, calibrations, reports."""
