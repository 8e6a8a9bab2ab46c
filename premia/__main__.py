from premia.cli import main

main()
