"""Sources: folders of files as tables, filtered before contents are read, and a data source of the parts of packages."""
