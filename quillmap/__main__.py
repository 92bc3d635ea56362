from quillmap.cli import main

main()
